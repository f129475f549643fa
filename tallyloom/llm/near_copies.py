"""Near copies: SimHash fingerprints of five-word shingles, compared bit-sliced, with exact similarity at the end.

Two texts are near copies if the sets of their shingles have a Jaccard similarity of ``ALIKE`` or more. Bits of
fingerprints at that similarity agree too seldom for keys made of bits, so texts meet under shingles. With shingles in a common
order, rare ones first, two near copies of n <= m shingles share one of the first n - ceil(8 n / 9) + 1 of the smaller
and the first m - ceil(4 m / 5) + 1 of the larger (for 4/5), whatever the order, so no pair is lost. A shingle that no text holds in the
first, shorter stretch joins nothing, which leaves out the common part of texts made from a template.

Under each shingle rows are first compared with one head, which joins many near copies at once. What is left
are rows of different groups under one shingle: their fingerprints are laid out in bit planes, and carry-save counters count
the differing bits of 64 pairs in one operation, leaving a block when all of its pairs are beyond ``RADIUS``. Pairs within
it are tested by counts of their hashes, which bound what two sets share, and then checked on the whole sets: ``FORESTS`` times only those of a forest, the closest that join the groups under a shingle,
which leaves few groups, and then all pairs of different groups. At a similarity of 4/5 some 19 of the 128 bits differ, with a deviation of 4, so
the radius loses none in practice. Shingles are told apart by 64 bits of hash, equal sets by 128.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import map_batches, sampled, ship, texts_of
from tallyloom.llm.components import components
from tallyloom.llm.simhash import Forest
from tallyloom.operators.lookup import hot_key_join
from tallyloom.session import written

SHINGLE_WORDS = 5
#: least similarity of near copies, as a fraction
ALIKE = (4, 5)
SEED = 42
RADIUS = 47
#: documents in which frequent shingles are looked for, in how many they are frequent, and how many are put last at most
SAMPLE, FREQUENT, MOST_FREQUENT = 8_192, 3, 200_000
#: rounds in which each shingle gives a forest of close pairs, before all are compared
FORESTS = 2
#: bits by which a pair may be preferred by chance to a closer one in all rounds but the first
JITTER = 12
BLOCK_CHECK = 16
TILE = 512
#: kinds of hashes that are counted, up to three of a kind, and pairs whose counts are compared at once
KINDS, CHECKED = 256, 1 << 14
#: pairs that a task holds back, to leave out repeats among them: 4 MB
HELD = 1 << 18
#: the odd number and shifts by which a hash gives 64 more bits
_SPREAD, _SHIFTS = np.uint64(0x9E3779B97F4A7C15), (np.uint64(32), np.uint64(29))


# -- fingerprints -------------------------------------------------------------------------------------------------------


def shingles(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of fewer words is one shingle, one without words has none."""
    parts = text.encode().lower().split()  # of bytes: A-Z only, and white space is space and \x09-\x0D
    if not parts:
        return np.zeros(0, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    grams = zip(*(parts[i:] for i in range(words)), strict=False) if len(parts) > words else [parts]
    return np.unique(np.fromiter((digest(join(s), SEED) for s in grams), np.uint64)).view(np.int64)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """128 bits as two unsigned longs: a bit is set if it is in over half of the hashes."""
    ones = np.zeros(128, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        h = hashes[at : at + (1 << 15)].view(np.uint64)
        more = (h ^ (h >> _SHIFTS[0])) * _SPREAD
        both = np.stack([h, more ^ (more >> _SHIFTS[1])], axis=1)
        ones += np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def counts(hashes: np.ndarray) -> bytes:
    """How many hashes have each lowest byte, three at most: a plane of low bits, then one of high bits."""
    n = np.minimum(np.bincount(hashes & (KINDS - 1), minlength=KINDS), 3)
    return np.packbits(np.stack([n & 1, n >> 1]).astype(bool), bitorder="little").tobytes()


def common_at_most(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Row by row the most hashes that sets of n and m, with these counts, can share.

    Of each kind no more than the smaller count, and of the uncounted ones no more than the set with fewer has.
    """

    def ones(planes: np.ndarray) -> np.ndarray:
        return np.bitwise_count(planes).sum(axis=1, dtype=np.int64)

    (xl, xh), (yl, yh) = np.hsplit(x, 2), np.hsplit(y, 2)
    counted = ones((xl | xh) & (yl | yh)) + ones(xh & yh) + ones(xl & xh & yl & yh)
    return counted + np.minimum(n - ones(xl) - 2 * ones(xh), m - ones(yl) - 2 * ones(yh))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, digest of the set, fingerprint (f0, f1), counts (h) and the set itself (s) of each row."""

    def step(batch):
        out: dict[str, list] = {"n": [], "digest": [], "f0": [], "f1": [], "h": [], "s": []}
        for text in texts_of(batch):
            s = shingles(text)
            f = fingerprint(s).view(np.int64)
            for name, value in zip(out, (len(s), xxhash.xxh128_digest(s.tobytes()), f[0], f[1], counts(s), s), strict=True):
                out[name].append(value)
        yield {"doc_id": batch.column(0), **out}

    return map_batches(docs.select("doc_id", "text"), step, "doc_id long, n long, digest binary, f0 long, f1 long, h binary, s array<long>")


# -- bit-sliced comparison ----------------------------------------------------------------------------------------------


def planes(prints: np.ndarray) -> np.ndarray:
    """(bits, words): bit i of row j is bit j of fingerprint i; ``prints`` is (fingerprints, words of a fingerprint)."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little").T
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)


def beyond(differences: Iterable[np.ndarray], radius: int) -> np.ndarray | None:
    """Mask of pairs with over ``radius`` differing bits; None when all are, which ends the block early.

    ``differences`` yields, bit by bit, the words of a differing bit of all pairs. The counters begin so high that the
    carry out of the topmost bit means radius + 1. Planes are taken two at a time: with the lowest counter bit they
    make a full adder, and only its carry goes on.
    """
    size = max(1, radius.bit_length())
    start = (1 << size) - (radius + 1)
    counters, over, waiting, none = [], None, None, ~np.uint64(0)
    for j, d in enumerate(differences):
        if over is None:
            counters = [np.full_like(d, none if start >> b & 1 else 0) for b in range(size)]
            over = np.zeros_like(d)
        if waiting is None:
            waiting = d
            continue
        low = counters[0]
        carry = (low & waiting) | (d & (low ^ waiting))
        low ^= waiting ^ d
        waiting = None
        for counter in counters[1:]:
            carry, counter[...] = carry & counter, counter ^ carry
        over |= carry
        if j % BLOCK_CHECK == BLOCK_CHECK - 1 and bool((over == none).all()):
            return None
    if waiting is not None:
        carry = waiting
        for counter in counters:
            carry, counter[...] = carry & counter, counter ^ carry
        over |= carry
    return over


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places (i in left, j in right) of fingerprints within the radius."""
    sliced = planes(right)
    bits = np.unpackbits(left.view(np.uint8).reshape(len(left), -1), axis=1, bitorder="little").astype(bool)
    pad = np.packbits(np.arange(sliced.shape[1] * 64) >= len(right), bitorder="little").view(np.uint64)
    found: list[np.ndarray] = []
    rows = max(1, (1 << 15) // sliced.shape[1])
    for at in range(0, len(left), rows):
        flip = np.where(bits[at : at + rows], ~np.uint64(0), np.uint64(0))
        over = beyond(((sliced[j][None, :] ^ flip[:, j][:, None]) | pad for j in range(len(sliced))), radius)
        if over is not None:
            near = np.unpackbits((~(over | pad)).view(np.uint8), axis=1, bitorder="little")
            found.append(np.argwhere(near) + (at, 0))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


# -- candidates ---------------------------------------------------------------------------------------------------------


def most(n: np.ndarray | int, up: int, down: int):
    """n - ceil(up * n / down) + 1: how many of n shingles must be looked at to meet up / down of them."""
    return n + (-up * n) // down + 1


def stretches(nodes: DataFrame, last: np.ndarray) -> DataFrame:
    """token, id, n, pos: shingles that a near copy shares one of, with their place in the order; ``last`` ones come last."""
    late = np.sort(last)

    def step(batch):
        tokens, ids, sizes, places = [], [], [], []
        for doc_id, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = s.values.to_numpy()
            n = len(s)
            if not n:
                continue
            at = np.minimum(np.searchsorted(late, s), max(len(late) - 1, 0))
            is_late = late[at] == s if len(late) else np.zeros(n, bool)
            first = np.concatenate([s[~is_late], s[is_late]])[: most(n, *ALIKE)]
            tokens.append(first)
            ids.append(np.full(len(first), doc_id))
            sizes.append(np.full(len(first), n))
            places.append(np.arange(len(first)))
        if tokens:
            yield dict(zip(("token", "id", "n", "pos"), (np.concatenate(c) for c in (tokens, ids, sizes, places)), strict=True))

    return map_batches(nodes.select("doc_id", "s"), step, "token long, id long, n int, pos int")


def frequent(found: DataFrame) -> np.ndarray:
    """Shingles of at least ``FREQUENT`` documents of the sample, the most frequent ones."""
    tokens = sampled(found, "doc_id", SAMPLE).select(F.explode("s").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    return np.array([r["token"] for r in counts.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).collect()], np.int64)


def _leads(n: Column, pos: Column) -> Column:
    """Whether the place is in the shorter stretch, which the smaller of two near copies needs."""
    up, down = 2 * ALIKE[0], ALIKE[0] + ALIKE[1]
    return pos < n - F.ceil(n * up / F.lit(down)) + 1


def _comparable(a: Column | str, b: Column | str) -> Column:
    """Whether sets of these sizes can be alike."""
    return ALIKE[1] * F.least(a, b) >= ALIKE[0] * F.greatest(a, b)


def shared(rows: DataFrame) -> DataFrame:
    """Rows of shingles that can join anything: two texts have them, one of them early."""
    every = Window.partitionBy("token")
    counted = rows.withColumns({"_n": F.count(F.lit(1)).over(every), "_lead": F.max(_leads(F.col("n"), F.col("pos"))).over(every)})
    return counted.where("_n > 1 and _lead").drop("_n", "_lead")


def verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b) whose whole sets are alike."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    whole = found.select("doc_id", "s").join(ids, "doc_id", "left_semi")
    left, right = whole.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), whole.select(F.col("doc_id").alias("b"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    alike = ALIKE[1] * both >= ALIKE[0] * (F.size("x") + F.size("y") - both)
    return pairs.join(left, "a").join(right, "b").where(alike).select("a", "b")


def within(rows: DataFrame, forest: int | None = None) -> DataFrame:
    """Pairs (a, b), b < a, of rows under one token that can be alike and are not in one component c.

    Rows of a token come to one task in order of component, in batches cut between tokens. Small groups stand side by
    side in a tile, whose rows are compared with one another. Of a larger group the rows of the largest component are
    compared with the others only, all others with all. With ``forest``, the number of a round, of the pairs
    under one token only those that join components, the closest first; each token and round takes others of the close ones.
    Near copies meet under many tokens; a task gives a pair again only after ``HELD`` others. ``rows``: token, id, n, pos, f0, f1, c, h.
    """
    ship(rows.sparkSession)
    dealt = rows.repartition("token").sortWithinPartitions("token", "c", "id").select("token", "id", "n", "pos", "f0", "f1", "c", "h")
    up, down, shorter = ALIKE[0], ALIKE[1], (2 * ALIKE[0], ALIKE[0] + ALIKE[1])

    def facing(prints, c) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Close places of a large group."""
        _, sizes = np.unique(c, return_counts=True)
        largest = np.repeat(np.arange(len(sizes)) == sizes.argmax(), sizes)
        others = np.flatnonzero(~largest)
        for a in range(0, len(others), TILE):
            left = others[a : a + TILE]
            for b in range(0, len(c), TILE):
                i, j = close_pairs(prints[left], prints[b : b + TILE])
                yield left[i], j + b

    def tiles(starts, ends) -> Iterator[tuple[int, int]]:
        """Ranges of whole groups of up to ``TILE`` rows, or of one larger group."""
        begin = 0
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - begin > TILE and s > begin:
                yield begin, s
                begin = s
        if len(ends) and ends[-1] > begin:
            yield begin, int(ends[-1])

    def joining(pairs, token, prints, c, ids) -> np.ndarray:
        """Pairs of places that join the components under each token, by distance."""
        distance = np.bitwise_count(prints[pairs[:, 0]] ^ prints[pairs[:, 1]]).sum(axis=1, dtype=np.int64)
        if forest:  # what was close and not alike is not to be taken every time
            mixed = (token[pairs[:, 0]] ^ ids[pairs[:, 0]] * 0x9E3779B1 ^ ids[pairs[:, 1]] * 0x85EBCA77) * (2 * forest + 1)
            distance += (mixed >> 13) % JITTER
        _, node = np.unique(np.stack([token, c], axis=1), axis=0, return_inverse=True)
        trees, kept = Forest(int(node.max(initial=-1)) + 1), []
        for k in np.argsort(distance, kind="stable").tolist():
            a, b = node[pairs[k, 0]], node[pairs[k, 1]]
            if trees.find(a) != trees.find(b):
                trees.link(a, b)
                kept.append(k)
        return pairs[kept]

    def flush(held: list[pa.RecordBatch]) -> np.ndarray:
        whole = pa.Table.from_batches(held)
        token, ids, n, pos, f0, f1, c = (whole.column(k).to_numpy() for k in range(7))
        counted = np.frombuffer(b"".join(whole.column(7).to_pylist()), np.uint64).reshape(len(ids), -1)
        n, pos, prints = n.astype(np.int64), pos.astype(np.int64), np.stack([f0, f1], axis=1).view(np.uint64)
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        found = []
        for begin, end in tiles(starts, np.r_[starts[1:], len(token)]):
            part = prints[begin:end]
            for x, y in facing(part, c[begin:end]) if end - begin > TILE else [close_pairs(part, part)]:
                x, y = x + begin, y + begin
                apart = (token[x] == token[y]) & (c[x] != c[y])
                x, y = x[apart], y[apart]
                small, big = np.where(n[x] <= n[y], x, y), np.where(n[x] <= n[y], y, x)
                early = (pos[small] < most(n[small], *shorter)) | ((n[x] == n[y]) & (pos[big] < most(n[big], *shorter)))
                reach = np.minimum(n[x] - pos[x], n[y] - pos[y])  # shingles that can be common from here on
                can = early & (down * n[small] >= up * n[big]) & ((up + down) * reach >= up * (n[x] + n[y]))
                x, y = x[can], y[can]
                for at in range(0, len(x), CHECKED):
                    i, j = x[at : at + CHECKED], y[at : at + CHECKED]
                    can = (up + down) * common_at_most(counted[i], counted[j], n[i], n[j]) >= up * (n[i] + n[j])
                    found.append(np.stack([i[can], j[can]], axis=1))
        pairs = ids[joining(np.concatenate(found), token, prints, c, ids) if forest is not None else np.concatenate(found)] if found else np.zeros((0, 2), np.int64)
        return np.unique(np.sort(pairs, axis=1), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        n = 0
        for pairs in filter(len, compared(batches)):
            kept.append(pairs)
            n += len(pairs)
            if n >= HELD:
                kept = [np.unique(np.concatenate(kept), axis=0)]
                n = len(kept[0])
                if n >= HELD // 2:
                    yield batch_of(kept.pop())
                    n = 0
        if kept:
            yield batch_of(np.unique(np.concatenate(kept), axis=0))

    def batch_of(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], names=["a", "b"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column(0).to_numpy()
            if held and held[-1].column(0)[-1].as_py() != token[0]:
                yield flush(held)
                held = []
            cut = int(np.searchsorted(token, token[-1]))  # tokens are sorted
            if cut:
                yield flush([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield flush(held)

    return dealt.mapInArrow(run, "a long, b long")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id of the documents that are not the one with the smallest id of their near copies.

    Ids are distinct and not null. Null texts count as empty, and texts without words are copies of one another. Near copies are linked over any
    number of pairs that are alike. Other columns are ignored; an empty table has none.
    """
    found = written(sketches(docs), "sketches")
    heads = found.groupBy("digest", "n").agg(F.min("doc_id").alias("id"))
    copies = found.select("doc_id", "digest").join(heads.select("digest", "id"), "digest").where("doc_id <> id").select("doc_id")
    # written frames are small files where there is little in them, so the sets are not shuffled to meet them
    copies = written(copies, "copies")
    nodes = found.join(copies, "doc_id", "left_anti")
    rows = written(shared(stretches(nodes, frequent(found))), "shared")
    prints = nodes.select(F.col("doc_id").alias("id"), "f0", "f1", "h")

    order = F.struct(F.xxhash64("id").alias("o"), F.col("id").alias("head"), F.col("n").alias("m"))
    first = rows.groupBy("token").agg(F.min(order).alias("h")).select("token", "h.head", "h.m")
    starred = hot_key_join(rows, first, ["token"], "inner", salted=False).where((F.col("id") != F.col("head")) & _comparable("n", "m"))
    tested = written(starred.select(F.greatest("id", "head").alias("a"), F.least("id", "head").alias("b")).distinct(), "pairs")
    left, right = (prints.select(F.col("id").alias(k), F.col("f0").alias(f"{k}0"), F.col("f1").alias(f"{k}1")) for k in "ab")
    distance = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    near = tested.join(left, "a").join(right, "b").where(distance <= RADIUS).select("a", "b")
    links = written(verified(written(near, "near"), found), "links")
    roots = components(links)

    for forest in [*range(FORESTS), None]:
        named = hot_key_join(rows, roots.select(F.col("vertex").alias("id"), "root"), ["id"], "left", salted=False).withColumn("c", F.coalesce("root", "id")).drop("root")
        mixed = named.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
        open_rows = hot_key_join(named, mixed, ["token"], "left_semi", salted=False).join(prints, "id")
        untested = written(within(open_rows, forest).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        more = written(verified(untested, found), "links")
        if not more.isEmpty():
            links, tested = links.select("a", "b").union(more.select("a", "b")), tested.select("a", "b").union(untested.select("a", "b"))
            roots = components(links)
    return written(copies.union(roots.select("vertex")).distinct(), "repeats")
