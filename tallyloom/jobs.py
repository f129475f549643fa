"""Jobs a scheduler would submit: ingest, preview, sync, backfill, rebuild."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.config import Settings
from tallyloom.functions import scalars as S
from tallyloom.operators.normalize import accepted, among, normalize, preview, with_identity
from tallyloom.session import written
from tallyloom.sinks.store import Outcome, Store
from tallyloom.sources.openbanking import incremental_since, parse_openbanking, read_records
from tallyloom.sources.registry import REGISTRY, Source, scan_staging, union_sources

Hook = Callable[[DataFrame], DataFrame]
NOTHING = Outcome(0, 0, ())


def ingest(
    spark: SparkSession,
    staging: str,
    store_root: str,
    settings: Settings,
    *,
    only: str | None = None,
    learned: DataFrame | None = None,
    hooks: Iterable[Hook] = (),
    registry: dict[str, Source] = REGISTRY,
    batch_id: int = 0,
    splits: bool = False,
) -> Outcome:
    """All staged files in one batch. Files stay where they are; the streaming ingest archives them."""
    records = scan_staging(spark, staging, only, registry)
    if records is None:
        return NOTHING
    return Store(spark, store_root).ingest(records, settings, learned, batch_id=batch_id, hooks=hooks, splits=splits)


def dry_run(
    spark: SparkSession, staging: str, store_root: str, settings: Settings, *, only: str | None = None
) -> DataFrame | None:
    """What an ingest would add; nothing is written to the store, not even exchange rates.

    The parsed batch is written once to the shared scratch folder, as by an ingest, so that files are not parsed for each use.
    """
    records = scan_staging(spark, staging, only)
    if records is None:
        return None
    records = written(with_identity(records), "dry-run")
    identified = accepted(records)
    facts = identified.agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_set(S.fy_of("txn_date")).alias("years"), F.coalesce(F.bool_or(S.keyed_by_reference()), F.lit(False)).alias("by_reference")
    ).first()
    stored = Store(spark, store_root).known_hashes(tuple(sorted(facts["years"])), facts["by_reference"])
    known = among(stored, identified, facts["n"])
    return preview(normalize(records, settings, known))


def sync(
    spark: SparkSession,
    landed: dict[str, str],
    store_root: str,
    settings: Settings,
    *,
    since: dt.date | None = None,
    learned: DataFrame | None = None,
) -> Outcome:
    """Landed open-banking records per source type, from the last synced day on (or ``since``), through the one pipeline."""
    store = Store(spark, store_root)
    frames = [parse_openbanking(read_records(spark, path), name, 9 + i) for i, (name, path) in enumerate(landed.items())]
    records = union_sources(frames)
    if since is None:
        records = incremental_since(records, store.transactions())
    else:
        records = records.where(F.col("txn_date").isNull() | (F.col("txn_date") >= F.lit(since)))
    return store.ingest(records, settings, learned)


def backfill_splits(spark: SparkSession, store_root: str, settings: Settings, fy: int | None = None) -> int:
    return Store(spark, store_root).backfill_splits(settings, fy)


def rebuild(
    spark: SparkSession,
    archive: str,
    store_root: str,
    settings: Settings,
    *,
    years: Iterable[int] = (),
    hooks: Iterable[Hook] = (),
) -> tuple[Store, DataFrame]:
    """Replay the archive into a new version of the store; gives the store and its coverage."""
    records = scan_staging(spark, archive)
    if records is None:
        raise FileNotFoundError(f"no archived files below {archive}")
    return Store(spark, store_root).rebuild(records, settings, years=tuple(years), hooks=tuple(hooks))
