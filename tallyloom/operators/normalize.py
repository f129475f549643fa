"""From parsed records to new transactions: identity, first copy, unseen ones, classification."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.config import Settings
from tallyloom.functions import scalars as S
from tallyloom.operators.accounts import resolve_account
from tallyloom.operators.rules import classify
from tallyloom.operators.splits import compute_splits
from tallyloom.schema import REJECT, TXN


def accepted(records: DataFrame) -> DataFrame:
    return records.where(F.col(REJECT).isNull()).drop(REJECT) if REJECT in records.columns else records


def quarantine(records: DataFrame) -> DataFrame:
    """Records that looked like transactions but could not be read; nothing is lost silently."""
    return records.where(F.col(REJECT).isNotNull())


def with_identity(records: DataFrame) -> DataFrame:
    return records.withColumn("dedup_hash", S.dedup_hash())


def first_copies(records: DataFrame, key: str = "dedup_hash", order: str = "arrival") -> DataFrame:
    """First record per identity in order of arrival.

    ``row_number() = 1`` is evaluated twice by Spark, once per task before the shuffle and once after it, so even a
    record copied millions of times sends one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return records.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def unseen(records: DataFrame, known_hashes: DataFrame) -> DataFrame:
    """Records whose identity is not stored yet. Hashes are uniform, so no partition is hot."""
    return records.join(known_hashes.select("dedup_hash"), "dedup_hash", "left_anti")


#: rows of a batch whose keys (64 characters each) are sent to every executor: some 20 MB
SMALL_BATCH = 200_000


def among(stored: DataFrame, batch: DataFrame, rows: int, key: str = "dedup_hash") -> DataFrame:
    """Stored keys that a batch of so many rows can hold.

    For a small batch the stored keys are filtered where they are read, by the batch's keys, so that what is shuffled
    later has the size of the batch, not of the store. A large batch is worth a shuffle of the stored keys.
    """
    if rows > SMALL_BATCH:
        return stored.select(key)
    return stored.select(key).join(F.broadcast(batch.select(key)), key, "left_semi")


@dataclass(frozen=True)
class Normalized:
    """``new``: TXN rows with ``raw``; ``quarantined``: rejected records."""

    new: DataFrame
    quarantined: DataFrame


def normalize(
    records: DataFrame,
    settings: Settings,
    known_hashes: DataFrame | None = None,
    learned: DataFrame | None = None,
    *,
    batch_id: int = 0,
    hooks: Iterable[Callable[[DataFrame], DataFrame]] = (),
    distinct_text: bool = False,
) -> Normalized:
    """One lazy plan from RAW_TXN records to new transactions; hooks run on the result in order.

    Records that bring their identity, as those of a parsed batch do, keep it.
    """
    kept = accepted(records)
    first = first_copies(kept if "dedup_hash" in kept.columns else with_identity(kept))
    if known_hashes is not None:
        first = unseen(first, known_hashes)
    txns = classify(first, settings, learned, distinct_text).withColumns(
        {
            "txn_id": F.col("dedup_hash"),
            "account_id": resolve_account(settings.accounts, file_name=S.file_base("source_file")),
            "notes": F.lit(None).cast("string"),
            "batch_id": F.lit(batch_id).cast("long"),
            "fee": F.coalesce("fee", F.lit(0)).cast("decimal(18,2)"),
            "fy": S.fy_of("txn_date"),
        }
    )
    out = txns.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TXN.fields], "raw")
    for hook in hooks:
        out = hook(out)
    return Normalized(out, quarantine(records) if REJECT in records.columns else records.limit(0))


def apply_splits(txns: DataFrame, settings: Settings) -> DataFrame:
    """Splits of new transactions, the optional last stage of an ingest."""
    return compute_splits(txns, settings.tax)


def preview(normalized: Normalized) -> DataFrame:
    """What an ingest would add, without writing anything."""
    return normalized.new.select(
        F.when(F.col("is_transfer"), "TRANSFER").otherwise("").alias("label"),
        "txn_date",
        "amount",
        F.substring("description", 1, 40).alias("description"),
        "category",
    )
