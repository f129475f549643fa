"""The session that takes a stream's files in, and what is made of their names."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.sinks.store import Store
from tallyloom.streaming.ingest import ingest_available


def test_stream_batches_are_taken_in_by_the_callers_session(spark, tmp_path, settings):
    (tmp_path / "staging" / "amex").mkdir(parents=True)
    (tmp_path / "staging" / "amex" / "a.csv").write_text("Date,Description,Amount\n01/02/2025,SHOP,10.00\n")
    seen = []

    def hook(df):
        seen.append(df.sparkSession.conf.get("spark.sql.adaptive.enabled"))
        return df

    ingest_available(spark, str(tmp_path / "staging"), str(tmp_path / "store"), settings, str(tmp_path / "check"), sources=("amex",), hooks=(hook,))
    assert seen == [spark.conf.get("spark.sql.adaptive.enabled")] == ["true"]
    assert Store(spark, str(tmp_path / "store")).transactions().count() == 1


PATHS = ["/in/ing_1.csv", "ing_1.csv", "a/b/", "", "/", "a.b/c", "/x/.csv", "/x/a.tar.gz", "a\n/b.csv", "a/b.csv\n", "file:///s/part-0.c000.csv"]


def test_names_of_files(spark):
    got = spark.createDataFrame([(p,) for p in [*PATHS, None]], "p string").select("p", S.file_base("p").alias("b"), S.file_stem("p").alias("s"), F.regexp_extract("p", r"([^/]+)$", 1).alias("b0"), F.regexp_extract("p", r"([^/]+?)(\.[^./]+)?$", 1).alias("s0"))
    for r in got.collect():
        assert (r["b"], r["s"]) == (r["b0"], r["s0"]), r


@pytest.mark.parametrize("make", [S.file_base, S.file_stem])
def test_no_pattern_runs_over_a_whole_path(spark, make):
    plan = spark.range(1).select(make(F.lit("/a/b.csv") + F.col("id")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert not re.search(r"regexp_extract\((?!substring_index)", plan)
