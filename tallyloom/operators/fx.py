"""Exchange rates read off converted transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.schema import HOME_CURRENCY

KEY = ["txn_date", "from_currency", "to_currency"]


def fx_candidates(raw: DataFrame) -> DataFrame:
    """(txn_date, from_currency, to_currency, rate, arrival) of every converted record.

    Records whose foreign amount was stored unconverted carry no rate: counting them would fix a rate of 1 for the
    day and hide the true one.
    """
    rate = S.fx_rate("amount", "original_amount", "original_currency")
    usable = rate.isNotNull() & ~S.unconverted_fx("amount", "original_amount", "original_currency")
    return raw.where(usable).select(
        "txn_date",
        F.col("original_currency").alias("from_currency"),
        F.lit(HOME_CURRENCY).alias("to_currency"),
        rate.alias("rate"),
        "arrival",
    )


def first_rates(candidates: DataFrame) -> DataFrame:
    """The first rate of a day and currency pair wins."""
    return candidates.groupBy(*KEY).agg(F.min_by("rate", "arrival").alias("rate"))


def extract_fx(raw: DataFrame) -> DataFrame:
    return first_rates(fx_candidates(raw))


def upsert_fx(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rates stay; new days are added. One grouping, no join."""
    both = existing.select(*KEY, "rate", F.lit(0).alias("_age")).unionByName(new.select(*KEY, "rate", F.lit(1).alias("_age")))
    return both.groupBy(*KEY).agg(F.min_by("rate", "_age").alias("rate"))
