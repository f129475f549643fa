"""What an ingest evaluates, shuffles and writes."""

from __future__ import annotations

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tallyloom.operators.normalize import normalize, with_identity
from tallyloom.sinks.store import Store


def test_new_rows_are_not_shuffled_again_for_the_staged_copy(spark, tmp_path, settings, make_records, monkeypatch):
    """First copies are dealt by identity; a second deal of whole rows spread them no better."""
    records = make_records(("A",), ("A",), ("B", "-1.00", "ing", "x.pdf", None, "2024-01-01"))

    def again(*_):
        raise AssertionError("rows are shuffled again")

    monkeypatch.setattr(type(records), "repartition", again)
    assert Store(spark, str(tmp_path)).ingest(records, settings).inserted == 2
    assert sorted(r["fy"] for r in Store(spark, str(tmp_path)).transactions().collect()) == [2024, 2025]


def test_identity_of_a_parsed_batch_is_not_made_again(settings, make_records):
    parsed = with_identity(make_records(("A",), ("B",)))
    assert normalize(parsed, settings).new._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    kept = normalize(parsed.withColumn("dedup_hash", F.col("description")), settings).new
    assert {r["txn_id"] for r in kept.collect()} == {"A", "B"}


def test_identities_are_stored_in_half_their_digits(spark, tmp_path, settings, make_records):
    Store(spark, str(tmp_path)).ingest(make_records(("A",)), settings)
    for name in ("transactions", "raw_audit"):
        (path,) = (tmp_path / "v0" / name).rglob("*.parquet")
        assert pq.ParquetFile(path).metadata.row_group(0).column(0).compression == "ZSTD"
