"""Near duplicates, components, top-k search and archive by brute force."""

import base64
import hashlib
import math
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import components, simhash, topk, warc


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_near_duplicates(messy, nothing):
    rows = messy.collect()
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(messy).collect()), key=str)
    prints = {r["doc_id"]: slow_fingerprint(r["text"] or "") for r in rows if r["doc_id"] is not None}
    ids = sorted(prints)
    root = roots(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (prints[ids[i]] ^ prints[ids[j]]).bit_count() <= 2])
    want = {k: ids[r] for k, r in zip(ids, root, strict=True)}
    assert got == sorted(((r["doc_id"], f"{slow_fingerprint(r['text'] or ''):016x}", want.get(r["doc_id"])) for r in rows), key=str)
    assert simhash.near_duplicates(nothing).count() == 0


def test_links_divide_crowded_keys_without_loss(spark):
    rnd = random.Random(2)
    seeds = [rnd.getrandbits(64) for _ in range(6)]
    fps = sorted({s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(5))) for s in seeds for _ in range(80)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, id long")
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    for hot in (3, 10_000):
        pairs = [tuple(r) for r in simhash.links(nodes, hot).collect()]
        assert all((fps[a] ^ fps[b]).bit_count() <= 64 and b < a for a, b in pairs)
        assert roots(len(fps), pairs) == want


def test_bit_sliced_distances():
    rnd = np.random.default_rng(1)
    left = rnd.integers(0, 1 << 63, 70, dtype=np.uint64)
    right = np.concatenate([left ^ (np.uint64(1) << rnd.integers(0, 64, 70).astype(np.uint64)) for _ in range(3)] + [left ^ np.uint64(7), left ^ np.uint64(5)])
    i, j = simhash.close_pairs(left, right)
    want = [(a, b) for a in range(len(left)) for b in range(len(right)) if int(left[a] ^ right[b]).bit_count() <= 2]
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 400)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 100 for i in range(101, 161)} | {i: 5 for i in range(200, 400)}


def test_top_k(spark):
    rnd = random.Random(4)
    vectors = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(i, [x + rnd.choice((0, 0.001)) for x in vectors[i % 12]]) for i in range(300)]
    rows += [(i, vectors[0]) for i in range(300, 400)]  # one vector very often
    rows += [(0, rows[0][1]), (400, None), (401, [1.0, None] * 3), (402, [float("nan")] * 6), (403, [math.inf] * 6), (404, []), (406, [3.0]), (None, vectors[1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, score long")
    held = {}
    for key, v in rows:
        if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            held[key] = [math.floor(256 * x) for x in v] + [0] * (6 - len(v))
    want = []
    for q in (k for k in held if k % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(held[q], v, strict=True)), k) for k, v in held.items() if k != q)
        want += [(q, n, k, -s) for n, (s, k) in enumerate(scored[:5], 1)]
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]


def test_archive_round_trip(spark, tmp_path):
    rows = [(3, "http://a/", "<p>é</p>"), (1, "http://b/", "<p>é</p>"), (1, "http://b/", "<p>é</p>"), (4, None, None), (5, "u\r\nv", ""), (None, "http://c/", "x"), (6, "http://d/", "y" * 200_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    records = warc.read_records(spark, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    first = {"<p>é</p>": 1, "": 4, "x": None, "y" * 200_000: 6}
    want = []
    for key, _, html in rows:
        body = (html or "").encode()
        revisit = key != first[html or ""]
        want.append((key, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first[html or ""] if revisit else None))
    assert sorted(map(tuple, warc.described(records).collect()), key=str) == sorted(want, key=str)
    for r in warc.restore(records).collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        block = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length"))[16:])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and rest[block:] == b"\r\n\r\n"
        assert b"revisit" in head or rest[:block].partition(b"\r\n\r\n")[2] == bytes(r["payload"])
    assert warc.archived_pages(pages.limit(0)).count() == 0
