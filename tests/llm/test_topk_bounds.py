"""What the top-k search sends to the driver, and its results where queries and blocks are dealt over many groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import topk


def asked():
    return F.col("vec_id") % 50 == 0


def slow(rows, k=5):
    held = [(key, np.floor(256 * np.array(v)).astype(np.int64)) for key, v in rows]
    want = []
    for q in sorted({key for key, _ in held if key % 50 == 0}):
        pairs = [(-int(x @ v), key) for row, x in held if row == q for key, v in held if key != q]
        want += [(q, n, key, -s) for n, (s, key) in enumerate(sorted(pairs)[:k], 1)]
    return want


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(4)


def nodes(plan):
    yield plan
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        inner = [plan.executedPlan()]
    elif name.endswith("QueryStageExec"):
        inner = [plan.plan()]
    else:
        inner = [plan.children().apply(i) for i in range(plan.children().size())]
    for child in inner:
        yield from nodes(child)


def test_what_is_broadcast_does_not_grow_with_rings(spark):
    rnd = np.random.default_rng(3)
    df = topk.top_k(frame(spark, list(enumerate(rnd.normal(0, 1, (3000, 32))))), asked())
    assert len(df.collect()) == 300
    plan = list(nodes(df._jdf.queryExecution().executedPlan()))
    sent = [p.metrics().get("dataSize").get().value() for p in plan if p.getClass().getSimpleName() == "BroadcastExchangeExec"]
    assert sum(sent) < 3_000_000, sent  # a hashed relation of any size has 1 MB


@pytest.mark.parametrize(("scale", "largest"), [(1, 1), (1_000_000, 1), (1, 100_000_000)])
def test_groups_of_queries_and_shelves(spark, monkeypatch, scale, largest):
    """Several groups of queries and many blocks a ring; components of two, four and eight bytes."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    monkeypatch.setattr(topk, "SHELF_BYTES", 256)
    rnd = np.random.default_rng(4)
    rows = [(i, scale * v) for i, v in enumerate(rnd.normal(0, 1, (900, 5)))]
    rows += [(i + 1000, v) for i, v in rows[:120]]  # equal vectors
    rows += [(2000, np.array([largest, 0, 0, 0, 0]))]
    got = sorted(map(tuple, topk.top_k(frame(spark, rows), asked()).collect()))
    assert got == slow(rows)


def test_one_id_with_many_vectors(spark, monkeypatch):
    gathered = []
    fit = topk.fit
    monkeypatch.setattr(topk, "FIT_ROWS", 100)
    monkeypatch.setattr(topk, "fit", lambda sample, *a: gathered.append(len(sample)) or fit(sample, *a))
    rnd = np.random.default_rng(5)
    rows = [(50, v) for v in rnd.normal(0, 1, (1500, 4))] + list(enumerate(rnd.normal(0, 1, (50, 4)))) + [(100, np.ones(4))]
    got = sorted(map(tuple, topk.top_k(frame(spark, rows), asked()).collect()))
    assert got == slow(rows)
    assert 50 < gathered[0] < 200


def test_vectors_without_components(spark):
    got = sorted(map(tuple, topk.top_k(frame(spark, [(0, []), (1, []), (2, [])]), asked()).collect()))
    assert got == [(0, 1, 1, 0), (0, 2, 2, 0)]


def test_products_are_exact():
    rnd = np.random.default_rng(6)
    for most in (200, 40_000, 3_000_000_000):
        q, x = (rnd.integers(-most, most, (n, 64)) for n in (7, 9))
        want = [[sum(map(math.prod, zip(a, b, strict=True))) for b in x.tolist()] for a in q.tolist()]
        if most < 1_000_000:
            assert topk.products(q, x).tolist() == want
        else:
            assert (topk.products(q, x).astype(object) % 2**64 == np.array(want, object) % 2**64).all()
