"""Mixing, manifest and prefix trie by brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import merkle, mixing, prefix_trie, scan


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def name_order(source):
    return (source is not None, (source or "").encode())


# -- places -------------------------------------------------------------------------------------------------------------


def test_places_along_hot_and_repeated_keys(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("aaaab"), rnd.choice([None, 1, 2, 2, 3]), rnd.randrange(100)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = scan.along(df, ["k"], ["o"], "n", {"s": ("sum", "v"), "x": ("xor", "v")}).collect()
    for k in "ab":
        mine = sorted((r for r in got if r["k"] == k), key=lambda r: r["n"])
        assert [r["n"] for r in mine] == list(range(sum(x[0] == k for x in rows)))
        assert [r["o"] for r in mine] == sorted((x[1] for x in rows if x[0] == k), key=lambda o: (o is not None, o))
        total = bits = 0
        for r in mine:
            total, bits = total + r["v"], bits ^ r["v"]
            assert (r["s"], r["x"]) == (total, bits)
    assert scan.along(df.limit(0), ["k"], ["o"], "n").count() == 0


# -- mixing -------------------------------------------------------------------------------------------------------------


def slow_targets(sizes):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: Fraction(3 * sizes[s]) if s in capped else Fraction(left * weight[s], free) for s in order}
        above = {s for s in order if target[s] > 3 * sizes[s]}
        if not above:
            return target
        capped |= above


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 9) for r in rows], "doc_id long, text string, source string, lang string, n_chars long")


def corpus(rnd):
    rows = [(i, " ".join("w" * rnd.randrange(1, 200)), "hot") for i in range(150)]
    rows += [(i, "one two", f"s{i % 7}") for i in range(200, 260)] + [(300, "a", "tiny"), (301, None, "silent"), (302, " \n", None), (303, "b c", None)]
    return rows + [(7, "same again", "s1")] * 20 + [(None, "no id", "s2")]


def test_mix_comes_near_its_targets(spark):
    rows = corpus(random.Random(3))
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = slow_targets(sizes)
    df = documents(spark, rows)
    for slot_words in (1, 16, 10**6):
        pieces = [r.asDict() for r in mixing.mix(df, slot_words).collect()]
        used, docs = {}, {}
        for p in pieces:
            source = p["source"] if p["named"] else None
            assert p["source_size"] == sizes[source] and abs(p["target"] - want[source]) < 1e-6
            spans = docs.setdefault((source, p["place"]), [p["doc_id"], p["size"], []])[2]
            if p["slot"] is not None:
                used[source] = used.get(source, 0) + p["length"]
                spans.append((p["repeat"], p["start"], p["length"]))
        assert sorted((d[0] is None, d[0], d[1]) for d in docs.values()) == sorted((i is None, i, len((t or "").split())) for i, t, _ in rows)
        assert all(abs(used.get(s, 0) - t) <= Fraction(1, 2) for s, t in want.items())
        for _, size, spans in docs.values():  # a document is read from its start to its end, then again
            at = [(r * size + start, length) for r, start, length in sorted(spans)]
            assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False)) and sum(n for _, n in at) <= 3 * size
            assert not at or at[0][0] == 0


def test_every_stretch_of_the_mix_holds_the_shares(spark):
    rows = [(i, "a " * 100, f"s{i % 5}") for i in range(500)]
    pieces = mixing.mix(documents(spark, rows), 16).where("slot is not null").groupBy("slot", "source").agg(F.sum("length").alias("n")).collect()
    slots = max(r["slot"] for r in pieces) + 1
    total = sum(r["n"] for r in pieces)
    share = {s: sum(r["n"] for r in pieces if r["source"] == s) / total for s in {r["source"] for r in pieces}}
    for upto in (slots // 8, slots // 3, slots // 2):
        part = [r for r in pieces if r["slot"] < upto]
        held = sum(r["n"] for r in part)
        assert all(abs(sum(r["n"] for r in part if r["source"] == s) / held - f) < 0.01 for s, f in share.items())


def test_mix_of_messy_rows_and_reruns(spark, messy, nothing):
    first, again = (sorted(map(tuple, mixing.taken(df).collect()), key=str) for df in (messy, messy.repartition(7)))
    assert first == again and len(first) == messy.count()
    assert mixing.taken(nothing).count() == 0
    silent = mixing.taken(documents(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert sorted(map(tuple, silent)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


# -- manifest -----------------------------------------------------------------------------------------------------------


def slow_manifest(rows):
    def framed(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return h("".join(framed(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    def grow(nodes):
        """Root, and for each node the pairs of texts before and after on its way."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(at):
                run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
                ways[i].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
            nodes, at = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)], [p // 16 for p in at]
        return nodes[0], ways

    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(sources, key=name_order)
    low = {s: grow([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    root, high = grow([low[s][0] for s in order])
    out = []
    for s, above in zip(order, high, strict=True):
        for (_, _, own, r), way in zip(sorted(sources[s], key=lambda x: x[:3]), low[s][1], strict=True):
            text, fold = r["text"], own
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                fold = leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
            for before, after in way + above:
                fold = h(before + fold + after)
            out.append((r["doc_id"], own, low[s][0], root, h("".join(b + a for b, a in way + above)), fold, fold == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("height", [0, 1, 3])
def test_manifest(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rnd = random.Random(height)
    rows = [(i, f"Text {i}", rnd.choice(("hot", "é", None)), "x", i) for i in range(340)]
    rows += [(1000 + i, "T", f"source {i}", None, None) for i in range(19)] + [(2000 + i, "U", "sixteen", "x", 1) for i in range(16)]
    rows += [(5, "Five", "hot", "x", 1)] * 3 + [(5, None, "hot", "x", 1), (None, "Nobody", "hot", "x", 1)]
    df = spark.createDataFrame([(*r, "leaf") for r in rows], "doc_id long, text string, source string, lang string, n_chars long, leaf string")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in merkle.manifest(df).collect()), key=str)
    assert got == slow_manifest(df.collect())
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_manifest_of_messy_rows(messy, nothing):
    got = sorted((tuple(r[c] for c in COLUMNS) for r in merkle.manifest(messy).collect()), key=str)
    assert got == slow_manifest(messy.collect())
    assert merkle.manifest(nothing).count() == 0
    one = messy.where("doc_id = 8")
    assert [tuple(r[c] for c in COLUMNS) for r in merkle.manifest(one).collect()] == slow_manifest(one.collect())


# -- trie ---------------------------------------------------------------------------------------------------------------


def slow_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, h(f"{len(role.encode())}:{role}{text}"), (role, text)))
    own = {c: [t[-1] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in own.items()}
    whole = {}
    for c, turns in own.items():
        n = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:n] + turns[n:])
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = sum(len(p) == len(path) + 1 for p in below)
        leaves = sum(not any(q[:-1] == p for q in nodes if len(q) == len(p) + 1) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in members if whole[c] == path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children, leaves, saved, h(ends)))
    return sorted(out, key=str)


TRIE = "conv_id long, turn long, role string, text string, depth long"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], TRIE)
    return sorted((tuple(r[c] for c in NODE) for r in prefix_trie.trie(df).collect()), key=str)


def test_trie_of_branching_and_copied_conversations(spark):
    rnd = random.Random(6)
    rows = []
    for c in range(0, 140):
        if c % 35 == 0:
            continue  # a base that is absent
        for t in range(rnd.choice((1, 2, 4, 9, 12))):
            rows.append((c, t, rnd.choice(("user", None)), rnd.choice(("a", "b", "é", ""))))
    for c in range(140, 170):  # copies, and prefixes of one another
        rows += [(c, t, "user", f"turn {t}") for t in range(10 if c % 3 else 10 + c % 7)]
    rows += [(900, None, None, None), (901, 3, "x", "y"), (901, None, "x", "z"), (901, 3, "x", "y"), (None, 1, "user", "lost")]
    assert trie_of(spark, rows) == slow_trie(rows)


def test_trie_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    rnd = random.Random(8)
    spine = [("user", f"s{i}") for i in range(40)]
    rows = []
    for c in range(5, 45):
        cut = rnd.randrange(41)
        turns = spine[:cut] + [("user", rnd.choice("pq")) for _ in range(rnd.randrange(6))]
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    assert trie_of(spark, rows) == slow_trie(rows)


def test_trie_of_nothing_and_of_one(spark):
    assert trie_of(spark, [(None, 1, "user", "x")]) == []
    rows = [(3, 0, "user", "only")]
    assert trie_of(spark, rows) == slow_trie(rows)


def test_two_fattest_depths(spark):
    pairs = [(a, b) for a in range(12) for b in range(12)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", prefix_trie.two_fattest(F.col("a"), F.col("b")).alias("f"))
    for a, b, f in df.collect():
        want = max(range(a + 1, b + 1), key=lambda n: n & -n, default=None)
        assert f == want
