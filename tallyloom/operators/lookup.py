"""Joins of a large frame to a lookup with unique keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: lookups built from configuration stay below this many rows, or they are not broadcast by hint
CONFIG_ROWS = 10_000


def config_frame(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """A frame of configuration rows. Its size is known on the driver, so it is broadcast only if it is small."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= CONFIG_ROWS else df


def splits_skew(spark: SparkSession) -> bool:
    """Whether the session divides the partitions of hot join keys at run time."""
    on = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return all(spark.conf.get(key, "true").lower() == "true" for key in on)


def default_salts(spark: SparkSession) -> int:
    """One salt per shuffle partition."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def hot_key_join(
    left: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left", *, salted: bool | None = None, salts: int | None = None
) -> DataFrame:
    """Join ``left`` to a lookup with unique keys, when one key may hold a large part of ``left``.

    No side is broadcast by hint: the optimizer does so below ``spark.sql.autoBroadcastJoinThreshold``, from size
    statistics or at run time. Beyond that, adaptive execution divides the partition of a hot key over many tasks.
    Where it is switched off the keys are salted: ``left`` spreads each key over ``salts`` partitions and the lookup
    is repeated that many times. Pass ``salted=True`` where a grouping by the same keys follows: that would keep
    adaptive execution from dividing the partition, while a salted join lets the grouping combine before it shuffles.
    ``salts`` defaults to the session's shuffle partitions, so that a hot key reaches as many tasks as there are.
    """
    if salted is None:
        salted = not splits_skew(left.sparkSession)
    if not salted:
        return left.join(lookup, keys, how)
    if salts is None:
        salts = default_salts(left.sparkSession)
    spread = [c for c in ("txn_id", "dedup_hash", "arrival", "seq") if c in left.columns] or [
        f.name for f in left.schema.fields if f.dataType.typeName() != "map"
    ]
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    salted_lookup = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(salted_lookup, [*keys, "_salt"], how).drop("_salt")
