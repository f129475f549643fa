"""Year in review: one small cube of the year feeds every breakdown; only merchants and top lists read rows again."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.config import Category
from tallyloom.functions import predicates as P
from tallyloom.functions import scalars as S
from tallyloom.operators.accounts import with_accounts
from tallyloom.plans.summaries import is_income, money_sum, savings_rate, top_merchants
from tallyloom.schema import TOTAL


def year_cube(txns: DataFrame, accounts: DataFrame | None, year: int) -> DataFrame:
    """Counts and sums of a year and the one before by month, category, source, sign, loan and transfer flag.

    Its size is bounded by the calendar and the configuration, whatever the number of transactions.
    """
    df = with_accounts(P.date_range(txns, dt.date(year - 1, 1, 1), dt.date(year, 12, 31)), accounts, "left")
    keys = {
        "is_current": F.col("txn_date") >= F.lit(dt.date(year, 1, 1)),
        "month": S.month_key("txn_date"),
        "sign": F.signum("amount").cast("int"),
        "has_account": F.col("account_type").isNotNull(),
        "is_loan": F.coalesce(F.col("account_type") == "loan", F.lit(True)),
    }
    grouped = df.groupBy(*[c.alias(n) for n, c in keys.items()], "category", "source_type", "is_transfer")
    return grouped.agg(money_sum().alias("total"), F.count(F.lit(1)).alias("count"))


def _lines(section: str, key: Column, condition: Column, amount2: Column | None = None) -> Column:
    """One contribution of a cube row to a section of the report, NULL where it has none."""
    entry = F.struct(
        F.lit(section).alias("section"),
        key.alias("item"),
        F.col("total").alias("amount"),
        F.col("count").alias("count"),
    )
    return F.when(condition, entry)


def year_lines(cube: DataFrame) -> DataFrame:
    """(section, item, count, amount) for every section that is a sum, from one pass over the cube."""
    current = F.col("is_current")
    kept = ~F.col("is_loan") & P.not_transfer()
    income, expense = F.col("sign") > 0, F.col("sign") < 0
    sections = F.array_compact(
        F.array(
            _lines("monthly_income", F.col("month"), current & kept & income),
            _lines("monthly_expenses", F.col("month"), current & kept & expense),
            _lines("category", F.col("category"), current & kept),
            _lines("business", F.col("category"), current & P.business_category() & F.col("has_account") & P.not_transfer()),
            _lines("source", F.col("source_type"), current),
            _lines("previous_income", F.lit("all"), ~current & kept & income),
            _lines("previous_expenses", F.lit("all"), ~current & kept & expense),
            _lines("income", F.lit("all"), current & kept & income),
            _lines("expenses", F.lit("all"), current & kept & expense),
        )
    )
    return (
        cube.select(F.inline(sections))
        .groupBy("section", "item")
        .agg(F.sum("count").alias("count"), F.sum("amount").cast(TOTAL).alias("amount"))
    )


def biggest(txns: DataFrame, accounts: DataFrame | None, year: int, *, income: bool, n: int = 5) -> DataFrame:
    """The n largest incomes or expenses of a year, loans included; a distributed top-k with arrival as tie-break."""
    df = with_accounts(P.in_year(txns, year), accounts).where(P.not_transfer())
    df = df.where(P.income() if income else P.expense())
    order = F.col("amount").desc() if income else F.col("amount").asc()
    return df.orderBy(order, "arrival").limit(n).select("txn_date", "description", "amount", "account_name")


def year_review(
    txns: DataFrame, accounts: DataFrame | None, categories: Iterable[Category], year: int
) -> dict[str, DataFrame]:
    cube = year_cube(txns, accounts, year)
    lines = year_lines(cube)
    current = cube.where("is_current")
    kept = current.where(~F.col("is_loan") & P.not_transfer())

    def signed(sign: int) -> Column:
        return F.sum(F.when(F.col("sign") == sign, F.col("total")).otherwise(F.lit(0).cast(TOTAL))).cast(TOTAL)

    monthly = kept.groupBy("month").agg(signed(1).alias("income"), signed(-1).alias("expenses")).orderBy("month")
    sums = monthly.agg(
        F.coalesce(F.sum("income"), F.lit(0)).cast(TOTAL).alias("total_income"),
        F.abs(F.coalesce(F.sum("expenses"), F.lit(0))).cast(TOTAL).alias("total_expenses"),
        F.count(F.lit(1)).alias("months"),
    )
    totals = sums.select(
        "total_income",
        "total_expenses",
        (F.col("total_income") - F.col("total_expenses")).cast(TOTAL).alias("net"),
        savings_rate("total_income", "total_expenses").alias("savings_rate"),
        (F.col("total_expenses").cast("double") / F.greatest("months", F.lit(1))).alias("avg_monthly_expense"),
    )
    previous = cube.where(~F.col("is_current") & ~F.col("is_loan") & P.not_transfer()).agg(
        signed(1).alias("income"), signed(-1).alias("expenses")
    )

    def by(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(key).agg(F.sum("total").cast(TOTAL).alias("total"), F.sum("count").alias("count"))

    return {
        "totals": totals,
        "monthly": monthly,
        "categories": by(kept, "category").withColumn("is_income", is_income(categories)).orderBy("total"),
        "top_merchants": top_merchants(txns, accounts, year=year, n=20),
        "business": by(current.where(P.business_category() & F.col("has_account") & P.not_transfer()), "category"),
        "previous_year": previous,
        "sources": by(current, "source_type").select("source_type", "count").orderBy(F.desc("count"), "source_type"),
        "biggest_expenses": biggest(txns, accounts, year, income=False),
        "biggest_income": biggest(txns, accounts, year, income=True),
        "lines": lines,
    }


def year_review_lines(txns: DataFrame, accounts: DataFrame | None, year: int) -> DataFrame:
    """The whole review in long form: (section, item, count, amount)."""
    merchants = top_merchants(txns, accounts, year=year, n=20).select(
        F.lit("merchant").alias("section"), F.col("merchant").alias("item"), "count", F.col("total").alias("amount")
    )

    def top(income: bool, section: str) -> DataFrame:
        return biggest(txns, accounts, year, income=income).select(
            F.lit(section).alias("section"),
            F.concat_ws(" ", F.date_format("txn_date", "yyyy-MM-dd"), "account_name").alias("item"),
            F.lit(1).cast("long").alias("count"),
            F.col("amount").cast(TOTAL).alias("amount"),
        )

    lines = year_lines(year_cube(txns, accounts, year))
    return lines.unionByName(merchants).unionByName(top(False, "biggest_expense")).unionByName(top(True, "biggest_income"))
