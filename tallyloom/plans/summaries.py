"""Income and spending summaries: by month, category, tag, merchant, source."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.config import UNCATEGORIZED, Category
from tallyloom.functions import predicates as P
from tallyloom.functions import scalars as S
from tallyloom.operators.accounts import with_accounts
from tallyloom.schema import TOTAL


def money_sum(value: Column | str = "amount") -> Column:
    return F.sum(F.col(value) if isinstance(value, str) else value).cast(TOTAL)


def positive_sum() -> Column:
    return money_sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(F.lit(0).cast("decimal(18,2)")))


def negative_sum() -> Column:
    return money_sum(F.when(F.col("amount") < 0, F.col("amount")).otherwise(F.lit(0).cast("decimal(18,2)")))


def is_income(categories: Iterable[Category]) -> Column:
    """Income flag of ``category``, NULL where there is no category."""
    names = [c.name for c in categories if c.is_income]
    flag = F.col("category").isin(*names) if names else F.lit(False)
    return F.when(F.col("category").isNotNull(), flag)


def transactions(
    txns: DataFrame,
    accounts: DataFrame | None = None,
    *,
    start: str | dt.date | None = None,
    end: str | dt.date | None = None,
    category: str | None = None,
    account: str | None = None,
    search: str | None = None,
    exclude_loans: bool = True,
    exclude_transfers: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """Filtered list, newest first, each row with its tags. With a limit this is a distributed top-k."""
    df = with_accounts(P.date_range(txns, start, end), accounts, "left")
    df = df.where(
        P.all_of(
            P.exclusions(exclude_loans, exclude_transfers),
            P.category_is(category) if category else None,
            P.account_is(account) if account else None,
            P.search(search) if search else None,
        )
    ).orderBy(F.col("txn_date").desc(), F.col("arrival").desc())
    return df.limit(limit) if limit is not None else df


def monthly_summary(
    txns: DataFrame,
    accounts: DataFrame | None = None,
    *,
    year: int | None = None,
    account: str | None = None,
    exclude_loans: bool = True,
    exclude_transfers: bool = True,
) -> DataFrame:
    df = with_accounts(P.in_year(txns, year), accounts)
    df = df.where(P.all_of(P.exclusions(exclude_loans, exclude_transfers), P.account_is(account) if account else None))
    return (
        df.groupBy(S.month_key("txn_date").alias("month"))
        .agg(negative_sum().alias("expenses"), positive_sum().alias("income"))
        .orderBy("month")
    )


def _filtered(txns, accounts, start, end, account, exclude_loans, exclude_transfers) -> DataFrame:
    df = with_accounts(P.date_range(txns, start, end), accounts)
    return df.where(
        P.all_of(P.exclusions(exclude_loans, exclude_transfers), P.account_is(account) if account else None)
    )


def category_summary(
    txns: DataFrame,
    categories: Iterable[Category],
    accounts: DataFrame | None = None,
    *,
    start: str | dt.date | None = None,
    end: str | dt.date | None = None,
    account: str | None = None,
    exclude_loans: bool = True,
    exclude_transfers: bool = True,
) -> DataFrame:
    """Total and count per category; transactions without a category form a group of their own."""
    df = _filtered(txns, accounts, start, end, account, exclude_loans, exclude_transfers)
    out = df.groupBy("category").agg(money_sum().alias("total"), F.count(F.lit(1)).alias("count"))
    return out.select("category", is_income(categories).alias("is_income"), "total", "count").orderBy("total")


def category_trend(
    txns: DataFrame,
    accounts: DataFrame | None = None,
    *,
    start: str | dt.date | None = None,
    end: str | dt.date | None = None,
    account: str | None = None,
    exclude_loans: bool = True,
    exclude_transfers: bool = True,
) -> DataFrame:
    """Expenses per month and category."""
    df = _filtered(txns, accounts, start, end, account, exclude_loans, exclude_transfers).where(P.expense())
    return (
        df.groupBy(S.month_key("txn_date").alias("month"), "category")
        .agg(money_sum().alias("total"))
        .orderBy("month", "category")
    )


OTHER_CATEGORIES = "Other categories"


def trend_pivot(trend: DataFrame, categories: Iterable[Category]) -> DataFrame:
    """Dense month x category grid of absolute expenses, 0 where a month has none.

    The columns are the configured categories, so no extra job looks for the distinct values, and one for all others, so
    that a month's columns add up to its spending.
    """
    configured = [c.name for c in categories]
    names = [*configured, OTHER_CATEGORIES]
    category = F.coalesce("category", F.lit(UNCATEGORIZED))
    labelled = trend.withColumn("category", F.when(category.isin(configured), category).otherwise(OTHER_CATEGORIES))
    grid = labelled.groupBy("month").pivot("category", names).agg(F.sum("total"))
    cells = [F.abs(F.coalesce(F.col(f"`{n}`"), F.lit(0).cast(TOTAL))).cast(TOTAL).alias(n) for n in names]
    return grid.select("month", *cells).orderBy("month")


def tag_summary(txns: DataFrame) -> DataFrame:
    """Count and total per tag over all transactions, loans and transfers included."""
    return (
        txns.select(F.explode("tags").alias("tag"), "amount")
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("count"), money_sum().alias("total"))
        .orderBy(F.desc("count"), "tag")
    )


def top_merchants(
    txns: DataFrame, accounts: DataFrame | None = None, *, year: int | None = None, n: int = 15
) -> DataFrame:
    """The n merchants with the largest spend; a merchant is the first 40 characters of the description."""
    df = with_accounts(P.in_year(txns, year), accounts).where(P.all_of(P.exclusions(), P.expense()))
    return (
        df.groupBy(S.merchant_key("description").alias("merchant"))
        .agg(
            F.min("description").alias("description"),
            F.count(F.lit(1)).alias("count"),
            money_sum().alias("total"),
        )
        .orderBy("total", "merchant")
        .limit(n)
    )


def source_counts(txns: DataFrame, year: int) -> DataFrame:
    """Transactions per source in a year, without any other filter."""
    return (
        P.in_year(txns, year)
        .groupBy("source_type")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "source_type")
    )


def business_by_category(txns: DataFrame, year: int) -> DataFrame:
    """``Business:`` categories of a year, loans included."""
    df = P.in_year(txns, year).where(P.business_category() & P.not_transfer())
    return df.groupBy("category").agg(money_sum().alias("total"), F.count(F.lit(1)).alias("count"))


def totals(monthly: DataFrame) -> DataFrame:
    """One row from a monthly summary: income, expenses, net, savings rate, average monthly expense."""
    sums = monthly.agg(
        F.coalesce(F.sum("income"), F.lit(0)).cast(TOTAL).alias("total_income"),
        F.abs(F.coalesce(F.sum("expenses"), F.lit(0))).cast(TOTAL).alias("total_expenses"),
        F.count(F.lit(1)).alias("months"),
    )
    return sums.select(
        "total_income",
        "total_expenses",
        (F.col("total_income") - F.col("total_expenses")).cast(TOTAL).alias("net"),
        savings_rate("total_income", "total_expenses").alias("savings_rate"),
        (F.col("total_expenses").cast("double") / F.greatest("months", F.lit(1))).alias("avg_monthly_expense"),
        "months",
    )


def savings_rate(income: str, expenses: str) -> Column:
    """Percent of income kept, 0 without income."""
    i, e = F.col(income).cast("double"), F.col(expenses).cast("double")
    return F.when(i > 0, (i - e) / i * 100).otherwise(F.lit(0.0))


def year_totals(txns: DataFrame, accounts: DataFrame | None, year: int) -> DataFrame:
    return totals(monthly_summary(txns, accounts, year=year))


def year_over_year(txns: DataFrame, accounts: DataFrame | None, year: int) -> DataFrame:
    """Totals of a year and of the one before (NULL without data), with percent changes (0 without a base). One scan."""
    window = P.date_range(txns, dt.date(year - 1, 1, 1), dt.date(year, 12, 31))
    df = with_accounts(window, accounts).where(P.exclusions())
    current = F.col("txn_date") >= F.lit(dt.date(year, 1, 1))
    zero = F.lit(0).cast("decimal(18,2)")

    def total(period: Column, sign: Column) -> Column:
        return money_sum(F.when(period, F.when(sign, F.col("amount")).otherwise(zero)))

    sums = df.agg(
        total(current, P.income()).alias("income"),
        total(current, P.expense()).alias("expenses"),
        total(~current, P.income()).alias("prev_income"),
        total(~current, P.expense()).alias("prev_expenses"),
    )

    def change(now: str, before: str) -> Column:
        n, b = (F.abs(F.coalesce(F.col(x), F.lit(0))).cast("double") for x in (now, before))
        return F.when(b > 0, (n - b) / b * 100).otherwise(F.lit(0.0))

    return sums.select(
        "*",
        change("income", "prev_income").alias("income_change"),
        change("expenses", "prev_expenses").alias("expense_change"),
    )


def category_share(summary: DataFrame, months: int | Column) -> DataFrame:
    """Spending categories with their share of all spending and monthly average; from a category summary.

    The window spans the summary, which has one row per category.
    """
    spending = summary.where(P.spending_rows()).select(
        F.coalesce("category", F.lit(UNCATEGORIZED)).alias("category"), "count", F.abs("total").cast(TOTAL).alias("spent")
    )
    whole = F.sum("spent").over(Window.partitionBy())
    m = F.lit(months) if isinstance(months, int) else months
    return spending.select(
        "category",
        "count",
        "spent",
        (F.col("spent").cast("double") / whole.cast("double") * 100).alias("pct"),
        (F.col("spent").cast("double") / F.greatest(m, F.lit(1))).alias("monthly_avg"),
    )


def incoming_by_category(txns: DataFrame, accounts: DataFrame | None, fy: int) -> DataFrame:
    df = with_accounts(P.in_fy(txns, fy), accounts).where(P.all_of(P.exclusions(), P.income()))
    return (
        df.groupBy(F.coalesce("category", F.lit(UNCATEGORIZED)).alias("category"))
        .agg(F.count(F.lit(1)).alias("count"), money_sum().alias("total"))
        .orderBy(F.desc("total"))
    )


def coverage(txns: DataFrame) -> DataFrame:
    """How much of the table the rules cover, and how many rows are transfers."""
    uncategorized = F.count_if(F.col("category").eqNullSafe(UNCATEGORIZED))
    counts = txns.agg(
        F.count(F.lit(1)).alias("total"),
        uncategorized.alias("uncategorized"),
        F.count_if(F.col("is_transfer")).alias("transfers"),
    )
    categorized = F.col("total") - F.col("uncategorized")
    return counts.select(
        "total",
        categorized.alias("categorized"),
        F.when(F.col("total") > 0, categorized.cast("double") / F.col("total") * 100).alias("categorized_pct"),
        "transfers",
    )


def amount_sum(txns: DataFrame, condition: Column, alias: str = "total") -> DataFrame:
    """Sum of the amounts that meet a condition, 0 for none."""
    return txns.where(condition).agg(F.coalesce(money_sum(), F.lit(0).cast(TOTAL)).alias(alias))
