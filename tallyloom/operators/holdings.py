"""Holdings: snapshots that replace everything, events that change units, cost and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.lookup import hot_key_join
from tallyloom.schema import TOTAL

UNITS = "decimal(28,6)"
NO_SEQ = -(2**62)


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Last snapshot per (asset_type, name), all columns replaced; its ``seq`` is where events begin to count."""
    values = [c for c in snapshots.columns if c not in ("asset_type", "name")]
    newest = snapshots.groupBy("asset_type", "name").agg(F.max_by(F.struct(*values), "seq").alias("_s"))
    return newest.select("asset_type", "name", "_s.*")


def _events_total(kind: str, value: Column) -> Column:
    return F.sum(F.when(F.col("event_type") == kind, value))


def holding_state(snapshots: DataFrame, events: DataFrame) -> DataFrame:
    """State of each holding after its events.

    ``snapshots``: asset_type, name, holding_id, seq, ticker, units, cost_basis, current_value, as_at_date, notes.
    ``events``: holding_id, seq, event_date, event_type, units, total_value. A buy adds units and cost, a sell takes
    units and leaves the cost, a valuation replaces value and date in order of arrival, other types change nothing.
    Only events after the last snapshot count.

    The folding is an aggregate with partial results, so a holding with very many events is no bottleneck.
    """
    latest = latest_snapshots(snapshots).withColumnRenamed("seq", "_from")
    # the grouping that follows has the key of this join, so the join is salted
    placed = hot_key_join(events, latest.select("holding_id", "_from"), ["holding_id"], "inner", salted=True)
    after = placed.where(F.col("seq") > F.coalesce("_from", F.lit(NO_SEQ)))
    units = F.coalesce(F.col("units").cast(UNITS), F.lit(0).cast(UNITS))
    folded = after.groupBy("holding_id").agg(
        _events_total("buy", units).alias("_bought"),
        _events_total("sell", units).alias("_sold"),
        _events_total("buy", F.col("total_value").cast(TOTAL)).alias("_cost"),
        F.max_by(
            F.struct(F.col("total_value").alias("v"), F.col("event_date").alias("d")),
            F.when(F.col("event_type") == "valuation", F.col("seq")),
        ).alias("_valued"),
    )
    out = latest.join(folded, "holding_id", "left")

    def zero(c: str, kind) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast(kind)

    return out.select(
        "holding_id",
        "asset_type",
        "name",
        "ticker",
        (zero("units", UNITS) + zero("_bought", UNITS) - zero("_sold", UNITS)).cast(UNITS).alias("units"),
        (zero("cost_basis", TOTAL) + zero("_cost", TOTAL)).cast(TOTAL).alias("cost_basis"),
        F.when(F.col("_valued").isNotNull(), F.col("_valued.v")).otherwise(F.col("current_value")).cast(TOTAL).alias("current_value"),
        F.when(F.col("_valued").isNotNull(), F.col("_valued.d")).otherwise(F.col("as_at_date")).alias("as_at_date"),
        "notes",
    )


def shown_value() -> Column:
    return F.coalesce("current_value", "cost_basis")


def events_of(events: DataFrame, holding_id: int | str) -> DataFrame:
    return events.where(F.col("holding_id") == holding_id).orderBy(F.col("event_date").desc(), F.col("seq").desc())


def events_by_holding(events: DataFrame) -> DataFrame:
    """All events ordered by holding and newest first; a range-partitioned sort, which splits a large holding."""
    return events.orderBy("holding_id", F.col("event_date").desc(), F.col("seq").desc())
