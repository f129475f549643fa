"""Changes as an append-only log, folded with 'the last one wins'.

Every fold is an aggregate with partial results per task, so an object that was edited very often costs one row per
task in the shuffle. ``seq`` is the order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.config import TaxConfig
from tallyloom.functions import predicates as P
from tallyloom.operators.splits import split_amount
from tallyloom.schema import PCT


def fold_latest(log: DataFrame, keys: list[str], seq: str = "seq", deleted: str | None = None) -> DataFrame:
    """Newest row per key; keys whose newest row is a deletion disappear."""
    values = [c for c in log.columns if c not in keys]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(seq)).alias("_row"))
    out = newest.select(*keys, "_row.*")
    return out if deleted is None else out.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def _category_edits(log: DataFrame, known: Iterable[str]) -> Column:
    return F.col("new_category").isin(*known)


def latest_edits(log: DataFrame, known_categories: Iterable[str]) -> DataFrame:
    """Per transaction its last category and its last note; one aggregate for both.

    ``log``: txn_id, seq, new_category, new_notes, has_notes. Unknown category names are ignored; a note may be set
    to NULL, so its presence is a flag of its own.
    """
    category = F.when(_category_edits(log, list(known_categories)), F.col("seq"))
    notes = F.when(F.col("has_notes"), F.col("seq"))
    return log.groupBy("txn_id").agg(
        F.max_by("new_category", category).alias("new_category"),
        F.max_by(F.struct("new_notes"), notes).alias("_notes"),
    )


def apply_edits(txns: DataFrame, log: DataFrame, known_categories: Iterable[str]) -> DataFrame:
    """Transactions with their last category (confidence 1.0) and note. The transfer flag stays as ingested."""
    edits = latest_edits(log, known_categories)
    out = txns.join(edits, "txn_id", "left")
    changed = F.col("new_category").isNotNull()
    notes = F.col("notes") if "notes" in txns.columns else F.lit(None).cast("string")
    return out.withColumns(
        {
            "category": F.coalesce("new_category", "category"),
            "confidence": F.when(changed, F.lit("1.0").cast("decimal(3,1)")).otherwise(F.col("confidence")),
            "notes": F.when(F.col("_notes").isNotNull(), F.col("_notes.new_notes")).otherwise(notes),
        }
    ).drop("new_category", "_notes")


def learned_rules(log: DataFrame, txns: DataFrame, known_categories: Iterable[str]) -> DataFrame:
    """(pattern, category, times_seen): what category edits teach, keyed by the upper-cased description.

    Edits are joined to the unique transaction ids first; the description, which may be very common, is only a
    grouping key with partial aggregation.
    """
    edits = log.where(_category_edits(log, list(known_categories))).select("txn_id", "seq", "new_category")
    named = edits.join(txns.select("txn_id", F.upper("description").alias("pattern")), "txn_id")
    return named.groupBy("pattern").agg(
        F.max_by("new_category", "seq").alias("category"), F.count(F.lit(1)).alias("times_seen")
    )


def apply_split_overrides(splits: DataFrame, log: DataFrame, txns: DataFrame, tax: TaxConfig) -> DataFrame:
    """Computed splits corrected by manual ones.

    ``log``: txn_id, seq, business (NULL = first one), business_pct (NULL = 0). A zero share deletes. Overrides of
    unknown transactions have no effect. A backfill of a year erases its older overrides, so pass only the log rows
    written since.
    """
    first = tax.businesses[0].name if tax.businesses else "Business"
    business = F.when(F.coalesce("business", F.lit("")) == "", first).otherwise(F.col("business"))
    pct = F.coalesce("business_pct", F.lit(0)).cast(PCT)
    latest = fold_latest(log.select("txn_id", "seq", business.alias("business"), pct.alias("business_pct")), ["txn_id", "business"])
    ordinals = F.create_map(*[x for i, b in enumerate(tax.businesses) for x in (F.lit(b.name), F.lit(i))]) if tax.businesses else None
    keep = [c for c in ("txn_id", "txn_date", "fy", "arrival", "amount") if c in splits.columns]
    manual = latest.join(txns.select(*keep), "txn_id").select(
        *keep,
        "business",
        (F.coalesce(F.try_element_at(ordinals, F.col("business")), F.lit(len(tax.businesses))) if ordinals is not None else F.lit(0)).alias("business_ord"),
        "business_pct",
        split_amount("amount", "business_pct").alias("business_amount"),
    )
    untouched = splits.join(latest.select("txn_id", "business"), ["txn_id", "business"], "left_anti")
    return untouched.unionByName(manual.where(F.col("business_pct") != 0))


def tax_overrides(log: DataFrame) -> DataFrame:
    """Current overrides: the last row per (fy, section, label), without the deleted ones. ``log`` has ``deleted``."""
    return fold_latest(log, ["fy", "section", "label"], deleted="deleted")


def current_trips(log: DataFrame, expenses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trips that were not deleted, by (fy, name), and the expenses of those trips only.

    A deletion names the trip as well; expenses belong to a trip_id, and a trip made again has a new one.
    """
    trips = fold_latest(log, ["fy", "name"], deleted="deleted")
    return trips, expenses.join(trips.select("trip_id"), "trip_id", "left_semi")


def since_backfill(log: DataFrame, txns: DataFrame, backfills: DataFrame) -> DataFrame:
    """Split overrides that are newer than the last backfill of their transaction's year.

    ``backfills``: fy, seq. It has a row per run and year, so it is small before and tiny after the aggregate.
    """
    last = backfills.groupBy("fy").agg(F.max("seq").alias("_backfilled"))
    dated = log.join(txns.select("txn_id", "fy"), "txn_id")
    kept = dated.join(last, "fy", "left").where(F.coalesce(F.col("seq") > F.col("_backfilled"), F.lit(True)))
    return kept.drop("fy", "_backfilled")


def delete_splits_of_fy(splits: DataFrame, txns: DataFrame, fy: int) -> DataFrame:
    """Splits left after those of a year's transactions are removed; only ids of that year are shuffled."""
    gone = P.in_fy(txns, fy).select("txn_id")
    return splits.join(gone, "txn_id", "left_anti")
