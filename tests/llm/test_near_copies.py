"""Near copies of the pipeline by brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tallyloom.llm import near_copies
from tallyloom.llm.common import table
from tests.llm.test_pairs import roots

SF = "/root/testdata/sf0.001"


def groups(texts):
    sets = []
    for text in texts:
        words = text.encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return roots(len(sets), near)


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, SF).collect())


def test_stage_takes_jaccard_of_five_words(spark):
    rows = sorted(table(spark, SF, "documents").select("doc_id", "text").collect())
    root = groups([r["text"] or "" for r in rows])
    assert kept(spark, rows) == [rows[i]["doc_id"] for i in sorted(set(root))]


def test_edited_copies_around_the_bound(spark, monkeypatch):
    rnd = random.Random(5)
    base = [[f"w{rnd.randrange(500)}" for _ in range(n)] for n in (5, 6, 30, 120, 300)]
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for words in base:
        for edits in [0, 0, 1, 2, 3, 4, 5, 6, 8, 12] * 3:
            new = list(words)
            for _ in range(min(edits, len(words) // 5)):
                new[rnd.randrange(len(new))] = f"x{rnd.random()}"
            texts.append(" ".join(new))
    texts += [" ".join([f"y{rnd.random()}" for _ in range(60)] + passage) for _ in range(40)]
    rnd.shuffle(texts)
    root = groups(texts)
    want = sorted(set(root))
    assert 40 < len(want) < len(texts) - 40
    assert kept(spark, list(enumerate(texts))) == want
    monkeypatch.setattr(near_copies, "FREQUENT", 10**6)  # the order of shingles must not matter
    monkeypatch.setattr(near_copies, "TILE", 7)
    assert kept(spark, list(enumerate(texts))) == want


@pytest.mark.parametrize("radius", [0, 2, 7, 47, 63])
def test_bit_sliced_distances_of_any_radius(radius):
    rnd = np.random.default_rng(radius)
    left = rnd.integers(0, 1 << 63, (70, 2), dtype=np.uint64)
    right = left.copy()
    for i, row in enumerate(right):
        for bit in rnd.choice(128, min(128, i + max(0, radius - 30)), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    i, j = near_copies.close_pairs(left, right, radius)
    want = [(a, b) for a in range(70) for b in range(70) if sum(int(x).bit_count() for x in left[a] ^ right[b]) <= radius]
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == want and want


def test_fingerprint_is_the_majority_of_bits():
    s = near_copies.shingles(" ".join(f"w{i}" for i in range(300)))
    f = near_copies.fingerprint(s)
    low = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in s.view(np.uint64)) > len(s))
    assert int(f[0]) == low and f[0] != f[1] and near_copies.fingerprint(s[:0]).tolist() == [0, 0]


@pytest.mark.parametrize("own", [6, 9])
def test_templates_meet_under_no_shingle(spark, own):
    """Texts of one template that are no near copies: what is compared doesn't grow with them."""
    template, rnd = " ".join(f"t{i}" for i in range(30)), random.Random(own)
    for n in (100, 400):
        rows = [(i, template + " " + " ".join(f"o{rnd.random()}" for _ in range(own))) for i in range(n)]
        found = near_copies.sketches(spark.createDataFrame(rows, "doc_id long, text string"))
        assert near_copies.shared(near_copies.stretches(found, near_copies.frequent(found))).count() == 0
        assert near_copies.repeats(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_large_groups_of_near_copies_and_chains(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(300):  # each a few edits from the first: one group, though many pairs are not alike
        new = list(words)
        for _ in range(rnd.randrange(3)):
            new[rnd.randrange(100)] = f"x{rnd.randrange(40)}"
        rows.append((i, " ".join(new)))
    rows += [(1000 + i, " ".join(f"c{j}" for j in range(i, i + 60))) for i in range(0, 60, 4)]  # a chain
    root = groups([t for _, t in rows])
    assert kept(spark, rows) == [rows[i][0] for i in sorted(set(root))]


def test_nulls_and_clashing_names(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "a b", 1), (4, "A  b", 1), (5, "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").selectExpr("*", "n AS digest", "n AS s", "n AS id", "n AS token")
    assert sorted(r["doc_id"] for r in near_copies.repeats(df).collect()) == [2, 4]
    assert near_copies.repeats(df.limit(0)).count() == 0


def test_counts_rule_out_no_pair_that_is_alike():
    rnd = np.random.default_rng(3)

    def at_most(*sets):
        x, y = (np.frombuffer(near_copies.counts(s), np.uint64)[None, :] for s in sets)
        return near_copies.common_at_most(x, y, *(np.array([len(s)]) for s in sets))[0]

    for n in (0, 1, 40, 400, 90_000):
        for changed in {0, min(1, n), n // 9, n // 4, n}:
            common, other = rnd.integers(-(2**62), 2**62, n - changed), rnd.integers(-(2**62), 2**62, (2, changed + 3))
            sets = np.concatenate([common, other[0]]), np.concatenate([common, other[1][:changed]])
            assert n - changed <= at_most(*sets) <= len(sets[1])
            slow = [[min(int((s & 255 == k).sum()), 3) for k in range(256)] for s in sets]
            assert at_most(*sets) == sum(map(min, *slow)) + min(len(s) - sum(c) for s, c in zip(sets, slow, strict=True))
    assert at_most(*rnd.integers(0, 2**62, (2, 150))) < 100  # and few others stay


def test_a_task_gives_a_pair_once(spark):
    """Two copies under 5 000 shingles, in more batches than one, are one pair of the task."""
    one, other = 2**40 + 1, 2**40 + 2
    rows = [(t, i, 100, 0, 7, 7, i, b"\0" * 64) for t in range(5000) for i in (one, other)]
    df = spark.createDataFrame(rows, "token long, id long, n int, pos int, f0 long, f1 long, c long, h binary")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert [tuple(r) for r in near_copies.within(df).collect()] == [(other, one)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
