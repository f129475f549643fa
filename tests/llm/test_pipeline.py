"""Registered queries against SQL, and each pipeline stage against what its operator says of every row."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tallyloom.llm import catalog as registered
from tallyloom.llm import secret_scan
from tallyloom.llm.common import table
from tests.compare import connection, difference
from tests.llm.test_near_copies import groups

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(registered.ORACLES))
def test_agrees_with_duckdb(spark, key):
    _, problem = difference(spark, connection(SF), registered.QUERIES[key], registered.ORACLES[key], SF)
    assert problem is None, problem


def test_all_are_registered():
    names = [k.split("_")[0] for k in registered.QUERIES]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 14))
    assert {*registered.QUERIES, "pipeline"} <= set(entry.queries())


def test_stages(spark):
    docs = table(spark, SF, "documents").withColumn("extra", F.lit(1))
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, SF)
    kept = {r["doc_id"] for r in good.collect()}
    assert all(k in kept for k, q in labels.items() if q == 1) and sum(k in kept for k, q in labels.items() if q == 0) <= 3
    spoken = stages["language ID"](spark, good, SF)
    assert {r["doc_id"] for r in spoken.collect()} >= {r["doc_id"] for r in good.where("length(text) > 40").collect()}
    rows = sorted(spoken.collect(), key=lambda r: r["doc_id"])
    heads = sorted(set(groups([r["text"] or "" for r in rows])))
    single = stages["SimHash near-dedup"](spark, spoken, SF)
    assert sorted(r["doc_id"] for r in single.collect()) == [rows[i]["doc_id"] for i in heads]
    clean = stages["secret scans"](spark, single, SF)
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == {r["doc_id"]: secret_scan.masked(r["text"]) for r in single.collect()}
    assert all(df.columns == docs.columns for df in (good, spoken, single, clean))
    packed = stages["packing"](spark, clean, SF)
    assert packed.select("doc_id").distinct().count() == clean.count()


def test_stages_on_messy_rows(spark, messy, nothing):
    for df in (messy, nothing):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF)
            df.count()


def test_near_dedup_keeps_one_of_repeated_rows(spark, messy):
    got = corpus_pipeline.near_dedup(spark, messy, SF).collect()
    ids = [r["doc_id"] for r in got]
    assert len(ids) == len(set(ids)) and None in ids and 6 in ids and 9 not in ids
