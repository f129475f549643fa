"""Budgets against actual spending."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.config import Category
from tallyloom.functions import predicates as P
from tallyloom.operators.accounts import with_accounts
from tallyloom.operators.lookup import config_frame
from tallyloom.plans.summaries import money_sum
from tallyloom.schema import CATEGORIES, TOTAL


def budget_vs_actual(
    txns: DataFrame,
    categories: Iterable[Category],
    month: str,
    accounts: DataFrame | None = None,
    *,
    exclude_loans: bool = True,
    exclude_transfers: bool = True,
) -> DataFrame:
    """Each budgeted category with what a month (``YYYY-MM``) spent of it; 0 where it spent nothing.

    The month is aggregated once for all categories; the budgets are a handful of configured rows.
    """
    budgeted = [(c.name, c.is_income, c.budget_monthly) for c in categories if c.budget_monthly is not None]
    spark = txns.sparkSession
    budgets = config_frame(spark, budgeted, CATEGORIES).withColumnRenamed("budget_monthly", "budget")
    df = with_accounts(P.in_month(txns, month), accounts)
    df = df.where(P.exclusions(exclude_loans, exclude_transfers)).where(
        F.col("category").isin(*[b[0] for b in budgeted]) if budgeted else F.lit(False)
    )
    actual = df.groupBy("category").agg(F.abs(money_sum()).alias("_actual"))
    out = budgets.join(actual, "category", "left").withColumn(
        "actual", F.coalesce("_actual", F.lit(0)).cast(TOTAL)
    )
    remaining = (F.col("budget") - F.col("actual")).cast(TOTAL)
    share = F.col("actual").cast("double") / F.col("budget").cast("double") * 100
    return out.select(
        "category",
        F.col("budget").cast(TOTAL).alias("budget"),
        "actual",
        remaining.alias("remaining"),
        "is_income",
        F.when(F.col("budget") > 0, F.least(share, F.lit(100.0))).otherwise(F.lit(0.0)).alias("pct"),
        (remaining < 0).alias("over"),
    )
