"""Places and running totals along sequences of any length, one of which may hold a large part of all rows.

Rows are range-partitioned by key and order, so a long sequence spans many tasks and short ones share a task. Each task's
part of a sequence is numbered and accumulated on its own; what came before a part follows from one row per part and
sequence. Rows that are equal in key and order are divided as well.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import written

PART, SPREAD = "_part", "_spread"


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _plus(a: Column, b: Column) -> Column:
    return a + b


#: how running values of each kind are made: aggregate, combination of two
KINDS = {"sum": (F.sum, _plus), "xor": (F.bit_xor, _xor)}


def along(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], place: str, running: Mapping[str, tuple[str, str]] | None = None
) -> DataFrame:
    """Add ``place`` (from 0) among the rows with the same ``keys``, in ``order``, and running values up to and with each row.

    ``running``: name of the new column -> (kind, column of longs without nulls). Keys must not be null. ``rows`` should be
    a written frame: it is read twice, once for the bounds of the ranges. Nulls in ``order`` come first. Rows that are
    equal in keys and order get places in no particular order among themselves. The result is written, so places don't
    change when a task is run again.
    """
    running = dict(running or {})
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn(SPREAD, F.monotonically_increasing_id()).repartitionByRange(parts, *keys, *order, SPREAD)
    dealt = written(dealt.withColumn(PART, F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(PART, *keys).agg(
        F.count(F.lit(1)).alias(place), *[KINDS[kind][0](column).alias(name) for name, (kind, column) in running.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        PART,
        *keys,
        F.coalesce(F.sum(place).over(earlier), F.lit(0)).alias(f"_before_{place}"),
        *[F.coalesce(KINDS[kind][0](name).over(earlier), F.lit(0)).alias(f"_before_{name}") for name, (kind, _) in running.items()],
    )
    inside = Window.partitionBy(PART, *keys).orderBy(*order, SPREAD)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns(
        {
            place: F.row_number().over(inside).cast("long") - 1,
            **{name: KINDS[kind][0](column).over(so_far) for name, (kind, column) in running.items()},
        }
    )
    joined = local.join(before, [PART, *keys])
    whole = {place: F.col(place) + F.col(f"_before_{place}")} | {
        name: KINDS[kind][1](F.col(name), F.col(f"_before_{name}")) for name, (kind, _) in running.items()
    }
    return written(joined.withColumns(whole).drop(PART, SPREAD, *[f"_before_{n}" for n in whole]), "places")
