"""Currency conversion rows of a payment provider, merged into the payment they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.lookup import hot_key_join
from tallyloom.schema import HOME_CURRENCY


def collapse_conversions(rows: DataFrame, is_conversion: Column, keep: Column) -> DataFrame:
    """Payments with the amount of their home-currency conversion row.

    ``rows``: file, txn_ref, parent_ref, currency, gross, arrival and anything else. ``is_conversion`` marks conversion
    rows, ``keep`` the rows that may become payments. Per parent, the first non-zero home-currency conversion row in
    file order gives the amount; a foreign parent keeps its own figure as original amount. Rows whose reference is
    that of a conversion row are dropped; blank references never match.

    Conversion rows are reduced to one row per parent before the join, so a parent with a great many of them stays
    small, and the rest is one lookup by unique keys; payments without a reference do not gather in one task.
    """
    conv = rows.where(is_conversion & (F.coalesce("parent_ref", F.lit("")) != ""))
    home = (F.trim("currency") == HOME_CURRENCY) & (F.col("gross") != 0)
    # each conversion row says something about two references: what its parent was converted to, and that its own
    # reference is not a payment
    about_parent = F.struct(
        F.col("parent_ref").alias("txn_ref"),
        F.when(home, F.struct("arrival", "gross")).alias("home"),
        F.lit(False).alias("own"),
    )
    about_self = F.struct(F.col("txn_ref"), F.lit(None).alias("home"), F.lit(True).alias("own"))
    facts = conv.select("file", F.inline(F.array(about_parent, about_self))).where(F.col("txn_ref") != "")
    lookup = facts.groupBy("file", "txn_ref").agg(
        F.min("home").alias("_home"),
        F.max(~F.col("own")).alias("_converted"),
        F.max("own").alias("_is_conv"),
    )
    lookup = lookup.select(
        "file",
        "txn_ref",
        F.col("_home.gross").alias("_home_gross"),
        F.when(F.col("_converted"), F.lit(1)).alias("_conversions"),
        "_is_conv",
    )
    payments = rows.where(keep & ~is_conversion)
    # payments without a reference match nothing; a key of their own each keeps them from gathering in one task
    blank = F.concat(F.lit("\u0000"), F.xxhash64("arrival").cast("string"))
    keyed = payments.withColumn("_ref", F.when(F.coalesce("txn_ref", F.lit("")) == "", blank).otherwise(F.col("txn_ref")))
    joined = hot_key_join(keyed, lookup.withColumnRenamed("txn_ref", "_ref"), ["file", "_ref"])
    joined = joined.where(~F.coalesce("_is_conv", F.lit(False))).drop("_ref")
    foreign = F.trim("currency") != HOME_CURRENCY
    converted = F.col("_home_gross").isNotNull() & foreign
    unconverted = foreign & F.col("_conversions").isNull()
    return joined.withColumns(
        {
            "amount": F.when(converted, F.col("_home_gross")).otherwise(F.col("gross")),
            "original_amount": F.when(converted | unconverted, F.col("gross")),
            "original_currency": F.when(converted | unconverted, F.trim("currency")),
            "currency": F.when(converted, F.lit(HOME_CURRENCY)).otherwise(F.trim("currency")),
        }
    ).drop("_home_gross", "_conversions", "_is_conv")
