"""SimHash near-duplicates: bit-sliced comparison of 64-bit fingerprints.

Fingerprints at most two bits apart agree in three of five bands of bits, so each distinct fingerprint stands under ten
keys. Fingerprints under one key are compared with one another by vertical bit planes: bit j of the differences of very
many pairs is one row of words, two carry-save counters count differing bits of all pairs at once, and a block is left
as soon as every pair of it is beyond the radius. A key under which too many fingerprints stand is divided again by
five bands of the bits that it does not fix. As distinct fingerprints, they share 53 bits or more then, which bounds a
group at 2^11, whatever the corpus; nothing is capped. A group gives links of a forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import map_batches, ship, texts_of
from tallyloom.llm.components import components
from tallyloom.session import written

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
BANDS = 5
#: keys with more fingerprints are divided again
HOT = 1024
#: fingerprints of a group that are compared with one another at once
TILE = 1024
BLOCK_CHECK = 8


# -- fingerprints -------------------------------------------------------------------------------------------------------


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles; bit set if set in over half of the hashes. No words: zero."""
    parts = text.encode().lower().split()  # of bytes: A-Z only, and white space is space and \x09-\x0D
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter(
        (digest(join(s), SEED) for s in zip(*(parts[i:] for i in range(words)), strict=False)), np.uint64, len(parts) - words + 1
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        piece = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row; null texts count as empty."""

    def step(batch):
        fps = np.array([fingerprint(t, words) for t in texts_of(batch)], np.uint64)
        yield {"doc_id": batch.column(0), "fp": fps.view(np.int64)}

    return map_batches(docs.select("doc_id", "text"), step, "doc_id long, fp long")


# -- bit-sliced comparison ----------------------------------------------------------------------------------------------


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit i of row j is bit j of fingerprint i. The last word is filled with zero bits."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)


def beyond(differences: Iterable[np.ndarray], radius: int = RADIUS) -> np.ndarray | None:
    """Mask of pairs with over ``radius`` differing bits; None when all are, which ends the block early.

    ``differences`` yields, bit by bit, the words of a differing bit of all pairs. Counters are kept bit-sliced: adding a
    plane is a chain of half adders, and what is carried out of the topmost counter bit has reached radius + 1.
    """
    assert radius == 2, "the counters below count to three"
    low = high = over = None
    for j, d in enumerate(differences):
        if low is None:
            low, high, over = d.copy(), np.zeros_like(d), np.zeros_like(d)
            continue
        carry = low & d
        low ^= d
        high_carry = high & carry
        high ^= carry
        over |= high_carry | (high & low)  # four, or three
        if j % BLOCK_CHECK == BLOCK_CHECK - 1 and bool((over == ~np.uint64(0)).all()):
            return None
    return over


def close_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i in left, j in right) of fingerprints within the radius, in blocks of left rows against right planes."""
    sliced = planes(right)
    bits = np.unpackbits(left.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    pad = np.zeros(sliced.shape[1] * 64, bool)
    pad[len(right) :] = True
    pad = np.packbits(pad, bitorder="little").view(np.uint64)
    found_i, found_j = [], []
    rows = max(1, (1 << 15) // sliced.shape[1])
    for at in range(0, len(left), rows):
        flip = np.where(bits[at : at + rows], ~np.uint64(0), np.uint64(0))
        over = beyond(((sliced[j][None, :] ^ flip[:, j][:, None]) | pad for j in range(64)))
        if over is None:
            continue
        near = np.unpackbits((~(over | pad)).view(np.uint8), axis=1, bitorder="little")
        i, j = np.nonzero(near)
        found_i.append(i + at)
        found_j.append(j)
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


class Forest:
    """Union of rows by smallest row."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def group_links(ids: np.ndarray, fps: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, smaller id) that join what is close inside the groups; rows are sorted by group, then id.

    Small groups stand side by side in a tile. Within a tile all pairs are compared, and pairs of one group count.
    """
    n = len(fps)
    forest = Forest(n)
    ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1
    begin = 0
    while begin < n:
        last = np.searchsorted(ends, begin + TILE, "right") - 1
        end = int(ends[last]) if last >= 0 and ends[last] > begin else int(ends[np.searchsorted(ends, begin, "right")])
        for a in range(begin, end, TILE):
            for b in range(a, end, TILE):
                i, j = close_pairs(fps[a : min(a + TILE, end)], fps[b : min(b + TILE, end)])
                i, j = i + a, j + b
                kept = (i < j) & (group[i] == group[j])
                for x, y in zip(i[kept].tolist(), j[kept].tolist(), strict=True):
                    forest.link(x, y)
        begin = end
    root = np.fromiter((forest.find(i) for i in range(n)), np.int64, n)
    moved = np.flatnonzero(root != np.arange(n))
    return ids[moved], ids[root[moved]]


# -- candidates ---------------------------------------------------------------------------------------------------------


def band_masks(bits: list[int]) -> list[int]:
    """Masks of three of five bands of the given bit positions, as signed longs."""
    bands = [sum(1 << b for b in bits[k::BANDS]) for k in range(BANDS)]
    masks = [a | b | c for a, b, c in combinations(bands, BANDS - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


FIRST = band_masks(list(range(64)))
SECOND = [band_masks([b for b in range(64) if not (m >> b) & 1]) for m in (x & ((1 << 64) - 1) for x in FIRST)]


def _keys(masks: list[int], also: Column | None = None) -> Column:
    """Array of (mask number, fingerprint under the mask)."""
    fp = F.col("fp")
    return F.array(
        *[F.struct(F.lit(k).alias("k"), fp.bitwiseAND(F.lit(m) if also is None else F.lit(m).bitwiseOR(also)).alias("v")) for k, m in enumerate(masks)]
    )


def _compared(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Links of rows that share the keys. Rows of a key come to one task, sorted, in batches cut between keys."""
    ship(keyed.sparkSession)
    dealt = keyed.repartition(*keys).sortWithinPartitions(*keys, "id")

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        whole = pa.Table.from_batches(rows)
        columns = [whole.column(k).to_numpy() for k in keys]
        changed = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns]) if len(whole) > 1 else np.zeros(0, bool)
        group = np.cumsum(np.r_[0, changed])
        a, b = group_links(whole.column("id").to_numpy(), whole.column("fp").to_numpy().view(np.uint64), group)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
            last = np.ones(batch.num_rows, bool)
            for c in columns:
                last &= c == c[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:
                yield flush([*held, batch.slice(0, cut)])
                held = []
            elif held:
                before = [held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() for k in keys]
                if before != [c[0] for c in columns]:
                    yield flush(held)
                    held = []
            held.append(batch.slice(cut))
        if held:
            yield flush(held)

    return dealt.mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b), b < a: links that join all fingerprints within the radius. ``nodes``: (fp, id), fingerprints distinct."""
    keyed = nodes.select("id", "fp", F.explode(_keys(FIRST)).alias("key")).select("id", "fp", "key.k", "key.v")
    counts = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keyed.join(counts, ["k", "v"])
    cold = _compared(shared.where(F.col("n") <= hot).select("k", "v", "id", "fp"), ["k", "v"])
    second = F.array(*[_keys(SECOND[k], F.lit(m)) for k, m in enumerate(FIRST)])
    divided = (
        shared.where(F.col("n") > hot)
        .select("id", "fp", "k", F.explode(F.get(second, F.col("k"))).alias("sub"))
        .select("id", "fp", "k", F.col("sub.k").alias("k2"), F.col("sub.v").alias("v2"))
    )
    return cold.union(_compared(divided, ["k", "k2", "v2"]))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of two bits or fewer).

    One row per input row. Null and empty texts have fingerprint zero and link like any other. A repeated row gets the
    same answer as its first. Rows with a null doc_id link nothing and have no component. Other columns are not carried on.
    Fingerprints are computed once and written to the shared folder; equal ones are joined before any comparison.
    """
    prints = written(fingerprints(docs, words), "fingerprints")
    nodes = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"))
    nodes = written(nodes, "distinct")
    roots = components(links(nodes, hot))
    named = nodes.join(roots, nodes["id"] == roots["vertex"], "left").select(
        F.col("fp"), F.coalesce("root", "id").alias("component_id")
    )
    joined = prints.join(named, "fp", "left")
    return joined.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
