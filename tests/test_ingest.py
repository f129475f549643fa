import hashlib

import pytest
from pyspark.sql import functions as F

from tallyloom import jobs
from tallyloom.operators import edits, normalize as N, splits as SP
from tallyloom.session import scratch_path
from tallyloom.sinks.store import Store
from tallyloom.streaming.ingest import ingest_available


def hashes(df):
    return [r["dedup_hash"] for r in N.with_identity(df).orderBy("arrival.seq").select("dedup_hash").collect()]


def test_identity(make_records):
    rows = make_records(
        ("Transfer to savings", "-50.00", "ing", "/in/account_a_2025.pdf"),
        ("Transfer to savings", "-50.00", "ing", "/in/account_b_2025.pdf"),
        ("Pixeldesk", "-17.46", "paypal", "x.csv", "TXN1"),
        ("Pixeldesk", "-17.46", "paypal", "y.csv", "TXN2"),
        ("Shop", "-5.00", "ing", "z", "basiq:9"),
        ("Shop", "-5.10", "coles", "z"),
    )
    want = [
        "2025-06-15|Transfer to savings|-50.0|account_a_2025",
        "2025-06-15|Transfer to savings|-50.0|account_b_2025",
        "TXN1",
        "TXN2",
        "basiq:9",
        "2025-06-15|Shop|-5.1",
    ]
    assert hashes(rows) == [hashlib.sha256(w.encode()).hexdigest() for w in want]


def test_ingest_twice_is_once(spark, settings, make_records):
    store = Store(spark, scratch_path(spark, "store"))
    rows = make_records(("WOOLWORTHS SYDNEY",), ("WOOLWORTHS SYDNEY",), ("Pixeldesk", "-17.46", "paypal", "p.csv", "T1"))
    first = store.ingest(rows, settings, batch_id=1)
    again = store.ingest(rows, settings, batch_id=1)
    assert (first.inserted, first.skipped, first.years) == (2, 1, (2025,))
    assert (again.inserted, again.skipped) == (0, 3)
    assert store.transactions().count() == 2 and store.raw_audit().count() == 2
    assert store.with_raw().where("description like 'WOOL%'").first()["raw"] == {"n": "0"}


def test_no_double_counting(spark, settings, make_records):
    rows = make_records(
        ("PAYPAL *PIXELDESK", "-17.46"), ("Pixeldesk", "-17.46", "paypal", "p.csv", "T1")
    )
    out = N.normalize(rows, settings).new
    kept = out.where("not is_transfer").agg(F.count("*").alias("n"), F.sum("amount").alias("s")).first()
    assert out.count() == 2 and kept["n"] == 1 and float(kept["s"]) == -17.46


def test_reference_seen_in_another_year(spark, settings, make_records):
    store = Store(spark, scratch_path(spark, "store"))
    store.ingest(make_records(("A", "-1.00", "paypal", "p", "T1", "2020-01-01")), settings)
    out = store.ingest(make_records(("A", "-1.00", "paypal", "p", "T1", "2024-01-01"), ("B", "-1.00", "coles", "p", None, "2024-01-01")), settings)
    assert (out.inserted, out.skipped) == (1, 1)


def test_account_by_file_prefix(spark, settings, make_records):
    rows = make_records(
        ("a", "-1.00", "ing", "/s/my_joint_2025.csv"), ("b", "-1.00", "ing", "/s/unknown.csv"), ("c", "-1.00", "hsbc", "/s/h.csv")
    )
    got = {r["description"]: r["account_id"] for r in N.normalize(rows, settings).new.collect()}
    assert got == {"a": "Joint", "b": "ING Orange Everyday", "c": "HSBC"}


def test_hot_key_keeps_everything(spark, settings, make_records):
    """A third of all rows are copies of one record, a third share one text; results stay whole."""
    rows = make_records(*[("WOOLWORTHS",)] * 300, *[("ALDI", f"-{i}.00") for i in range(1, 301)], *[(f"SHOP {i}",) for i in range(300)])
    out = N.normalize(rows, settings, distinct_text=True).new
    counts = {r["category"]: r["count"] for r in out.groupBy("category").count().collect()}
    assert counts == {"Groceries": 301, "Uncategorized": 300}


def test_first_copy_is_limited_before_the_shuffle(spark, make_records):
    plan = N.first_copies(N.with_identity(make_records(("A",))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_splits(spark, settings):
    rows = [
        (1, "2024-09-01", "-120.00", "Business: Hosting", [], False),
        (2, "2024-10-01", "-8.00", "Business: Software", ["internet"], False),
        (3, "2024-08-01", "-80.00", "Utilities", ["internet"], False),
        (4, "2024-08-01", "-80.00", "Utilities", ["mobile", "internet"], False),
        (5, "2024-08-01", "-80.00", "Utilities", [], False),
        (6, "2024-08-01", "-80.00", "Groceries", ["mobile"], False),
        (7, "2024-08-01", "-80.00", None, ["mobile"], False),
        (8, "2024-08-01", "-80.00", "Business: Hosting", [], True),
        (9, "2024-06-30", "-80.00", "Business: Hosting", [], False),
        (10, "2025-06-30", "-0.25", "Utilities", ["mobile"], False),
    ]
    txns = spark.createDataFrame(rows, "txn_id long, d string, a string, category string, tags array<string>, is_transfer boolean")
    txns = txns.select("*", F.to_date("d").alias("txn_date"), F.col("a").cast("decimal(18,2)").alias("amount"))
    out = SP.compute_splits(txns, settings.tax, 2025)
    got = sorted((r["txn_id"], r["business"], float(r["business_pct"]), float(r["business_amount"])) for r in out.collect())
    assert got == [
        (1, "First Pty", 100.0, -120.0),
        (2, "First Pty", 100.0, -8.0),
        (3, "First Pty", 2.0, -1.6),
        (4, "First Pty", 2.0, -1.6),
        (4, "Second Pty", 10.0, -8.0),
        (10, "First Pty", 3.0, -0.01),
        (10, "Second Pty", 10.0, -0.03),
    ]
    log = spark.createDataFrame(
        [(3, 1, None, 50.0), (3, 2, None, 0.0), (5, 3, "Second Pty", 25.0), (4, 4, "First Pty", 1.0), (99, 5, None, 5.0)],
        "txn_id long, seq long, business string, business_pct double",
    )
    fixed = edits.apply_split_overrides(out, log, txns, settings.tax)
    got = {(r["txn_id"], r["business"]): float(r["business_amount"]) for r in fixed.where("txn_id in (3, 4, 5, 99)").collect()}
    assert got == {(4, "First Pty"): -0.8, (4, "Second Pty"): -8.0, (5, "Second Pty"): -20.0}


CSV_HEAD = "Date,Description,Card Member,Account #,Amount,Foreign Spend Amount,Commission,Exchange Rate\n"


def stage(tmp_path, name, *rows):
    folder = tmp_path / "staging" / "amex"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(CSV_HEAD + "".join(f"{d},{t},A,1,{a},,,\n" for d, t, a in rows), encoding="utf-8")


def test_stream_equals_batch_and_archives(spark, settings, tmp_path):
    stage(tmp_path, "a.csv", ("01/02/2025", "ALDI", "10.00"), ("02/02/2018", "QUILL LANE", "5.00"))
    stage(tmp_path, "b.CSV", ("01/02/2025", "ALDI", "10.00"), ("31/02/2025", "BAD", "1.00"))
    staging, archive, check = str(tmp_path / "staging"), str(tmp_path / "archive"), str(tmp_path / "check")
    batch_root, stream_root = str(tmp_path / "batch"), str(tmp_path / "stream")
    preview = jobs.dry_run(spark, staging, batch_root, settings)
    assert sorted(r["description"] for r in preview.collect()) == ["ALDI", "QUILL LANE"]
    assert not (tmp_path / "batch").exists()
    assert jobs.ingest(spark, staging, batch_root, settings).inserted == 2
    ingest_available(spark, staging, stream_root, settings, check, archive=archive, max_files=1)
    columns = ("dedup_hash", "txn_date", "amount", "category", "fy")

    def content(root):
        return sorted(map(tuple, Store(spark, root).transactions().select(*columns).collect()))

    assert content(stream_root) == content(batch_root)
    assert Store(spark, stream_root).quarantined().count() == 1
    archived = [p.name for p in (tmp_path / "archive").rglob("*.[cC]*[vV]")]
    assert sorted(archived) == ["a.csv", "b.CSV"] and not list((tmp_path / "staging").rglob("*.[cC]*[vV]"))
    stage(tmp_path, "c.csv", ("05/02/2025", "LATE", "7.00"))
    ingest_available(spark, staging, stream_root, settings, check, archive=archive)
    assert len(content(stream_root)) == 3
    assert len(list((tmp_path / "archive").rglob("*.[cC]*[vV]"))) == 3
    archived = next(p for p in (tmp_path / "archive").rglob("staging") if p.is_dir())
    store, coverage = jobs.rebuild(spark, str(archived), batch_root, settings, years=(2025,))
    assert store.version == 1 and Store(spark, batch_root).version == 1
    assert coverage.first()["total"] == store.transactions().count()


def test_archive_moves_only_what_is_in_the_store_and_can_be_repeated(spark, tmp_path):
    from tallyloom.sources.registry import REGISTRY
    from tallyloom.streaming import ingest as STREAM

    stage(tmp_path, "a [1] ä.csv", ("01/02/2025", "ALDI", "10.00"))
    stage(tmp_path, "b.csv", ("01/02/2025", "ALDI", "11.00"))
    folder, check, archive = tmp_path / "staging" / "amex", str(tmp_path / "check"), str(tmp_path / "archive")

    def note(batch, *names):
        rows = [(f"file:{folder / n}", batch) for n in names]
        spark.createDataFrame(rows, STREAM.TAKEN).write.parquet(f"{check}/amex-taken/{batch}")

    note(0, "a [1] ä.csv", "gone.csv")
    note(1, "b.csv")
    assert STREAM.archive_taken(spark, REGISTRY["amex"], check, archive, before=1) == 1
    assert [p.name for p in folder.iterdir()] == ["b.csv"]
    assert [r["batch"] for r in STREAM.taken_files(spark, REGISTRY["amex"], check).collect()] == [1]
    assert STREAM.archive_taken(spark, REGISTRY["amex"], check, archive) == 1
    assert STREAM.archive_taken(spark, REGISTRY["amex"], check, archive) == 0
    assert sorted(p.name for p in (tmp_path / "archive").rglob("*.csv")) == ["a [1] ä.csv", "b.csv"]


def test_one_large_streamed_file_is_read_by_many_tasks(spark, settings, tmp_path):
    stage(tmp_path, "a.csv", ("01/02/2025", '"two\nlines"', "1.00"), *[("01/02/2025", f"SHOP {i}", "1.00") for i in range(2000)])
    staging, root = str(tmp_path / "staging"), str(tmp_path / "store")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        ingest_available(spark, staging, root, settings, str(tmp_path / "check"), sources=("amex",))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    stored = Store(spark, root).transactions()
    assert stored.count() == 2001 and stored.select("arrival.block").distinct().count() > 5


def test_backfill_replaces_a_year_even_when_empty(spark, settings, make_records):
    from dataclasses import replace

    from tallyloom.config import TaxConfig

    store = Store(spark, scratch_path(spark, "store"))
    store.ingest(make_records(("QUILL LANE", "-10.00", "coles", "f", None, "2024-10-15")), settings)
    assert store.backfill_splits(settings, 2025) == 1 and store.backfill_splits(settings, 2024) == 0
    assert store.splits().count() == 1
    assert store.backfill_splits(replace(settings, tax=TaxConfig()), 2025) == 0
    assert store.splits().count() == 0


def test_small_batch_is_matched_without_a_shuffle_of_the_store(spark, make_records, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    batch = N.with_identity(make_records(("A",), ("B",)))
    wide = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("dedup_hash"))
    wide.union(batch.where("description = 'A'").select("dedup_hash")).write.parquet(store.path("stored"))
    stored = spark.read.parquet(store.path("stored"))
    small = N.among(stored, batch, 2)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert small.count() == 1
    monkeypatch.setattr(N, "SMALL_BATCH", 1)
    assert N.among(stored, batch, 2).count() == 1001
    assert [r["description"] for r in N.unseen(batch, N.among(stored, batch, 2)).collect()] == ["B"]


def test_ingest_with_splits_leaves_no_scratch_and_compacts(spark, settings, make_records, tmp_path):
    from pathlib import Path

    from tallyloom.session import scratch_root

    store = Store(spark, str(tmp_path / "store"))
    before = set(Path(scratch_root(spark).removeprefix("file:")).glob("*"))
    for i in range(3):
        rows = make_records((f"QUILL LANE {i}", "-10.00", "coles", "f", None, "2024-10-15"), (f"QUILL LANE {i}", "-7.00", "coles", "f", None, "2023-10-15"))
        store.ingest(rows, settings, batch_id=i, splits=True)
        store.ingest(rows, settings, batch_id=i, splits=True)
    assert set(Path(scratch_root(spark).removeprefix("file:")).glob("*")) == before
    assert store.splits().count() == 6
    columns = ("dedup_hash", "amount", "fy")

    def content(s):
        return sorted(map(tuple, s.with_raw().select(*columns, F.map_values("raw")).collect()))

    fresh = store.compact()
    assert content(fresh) == content(store) and Store(spark, store.root).version == fresh.version
    assert fresh.splits().count() == 6
    years = list((tmp_path / "store" / "v1" / "transactions").rglob("fy=*"))
    assert len(years) == 2 and all(len(list(p.glob("*.parquet"))) == 1 for p in years)
    assert store.ingest(make_records(("AFTERWARDS",)), settings).inserted == 1 and store.version == 1
    assert fresh.transactions().count() == 7


class Interrupted(Store):
    """A writer to which something happens just before its first commit."""

    happens = None

    def _commit(self, *args, **more):
        happens, self.happens = self.happens, None
        if happens is not None:
            happens()
        return super()._commit(*args, **more)


def interrupted(spark, root, happens):
    store = Interrupted(spark, root)
    store.happens = happens
    return store


def test_two_writers_at_once_leave_each_row_once(spark, settings, make_records, tmp_path):
    root = str(tmp_path / "store")
    same, other = make_records(("A",), ("B",), ("C",)), make_records(("B",), ("D",))
    outcomes = []
    first = interrupted(spark, root, lambda: outcomes.append(Store(spark, root).ingest(other, settings, splits=True)))
    outcomes.append(first.ingest(same, settings, splits=True))
    assert [(o.inserted, o.skipped) for o in outcomes] == [(2, 0), (2, 1)]
    store = Store(spark, root)
    assert sorted(r["description"] for r in store.transactions().collect()) == ["A", "B", "C", "D"]
    assert store.raw_audit().count() == 4 and store.with_raw().where("raw is null").count() == 0
    # a writer whose rows the other one doesn't have is not repeated
    apart = interrupted(spark, root, lambda: Store(spark, root).ingest(make_records(("E",)), settings))
    assert apart.ingest(make_records(("F",)), settings).inserted == 1
    assert store.transactions().count() == 6 and [c["seq"] for c in store.commits()] == [1, 2, 3, 4]


def test_a_crash_before_the_commit_leaves_nothing(spark, settings, make_records, tmp_path):
    def crash():
        raise KeyboardInterrupt

    root, rows = str(tmp_path / "store"), make_records(("A",), ("B",))
    with pytest.raises(KeyboardInterrupt):
        interrupted(spark, root, crash).ingest(rows, settings, splits=True)
    store = Store(spark, root)
    assert [store.transactions().count(), store.raw_audit().count(), store.splits().count(), store.fx_rates().count()] == [0, 0, 0, 0]
    assert store.ingest(rows, settings).inserted == 2 and store.ingest(rows, settings).inserted == 0
    assert store.transactions().groupBy("dedup_hash").count().where("count > 1").isEmpty()


def test_compaction_and_backfill_lose_no_commit(spark, settings, make_records, tmp_path):
    root = str(tmp_path / "store")
    Store(spark, root).ingest(make_records(("QUILL LANE", "-10.00", "coles", "f", None, "2024-10-15")), settings)
    late = make_records(("QUILL LANE", "-20.00", "coles", "f", None, "2024-11-15"))
    fresh = interrupted(spark, root, lambda: Store(spark, root).ingest(late, settings)).compact()
    assert fresh.version == 1 and fresh.transactions().count() == 2
    more = make_records(("QUILL LANE", "-30.00", "coles", "f", None, "2024-12-15"))
    assert interrupted(spark, root, lambda: Store(spark, root).ingest(more, settings)).backfill_splits(settings, 2025) == 3
    assert Store(spark, root).splits().count() == 3
    # a writer that began before a compaction ends up in the version after it
    old = interrupted(spark, root, lambda: Store(spark, root).compact())
    assert old.ingest(make_records(("NEW",)), settings).inserted == 1
    assert Store(spark, root).version == 2 and Store(spark, root).transactions().count() == 4
