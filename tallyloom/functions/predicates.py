"""Report filters. Dates are always compared as ranges, so that they reach partition pruning and the Parquet footer."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.config import BUSINESS_PREFIX, UNCATEGORIZED
from tallyloom.functions import scalars as S


def _date(value: str | dt.date) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def all_of(*conditions: Column | None) -> Column:
    present = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, present, F.lit(True)) if present else F.lit(True)


def date_range(df: DataFrame, start: str | dt.date | None = None, end: str | dt.date | None = None) -> DataFrame:
    """Inclusive date range; also bounds the ``fy`` partition column where the table has one."""
    has_fy = "fy" in df.columns
    if start is not None:
        d = _date(start)
        df = df.where(F.col("txn_date") >= F.lit(d))
        df = df.where(F.col("fy") >= d.year + (d.month >= 7)) if has_fy else df
    if end is not None:
        d = _date(end)
        df = df.where(F.col("txn_date") <= F.lit(d))
        df = df.where(F.col("fy") <= d.year + (d.month >= 7)) if has_fy else df
    return df


def in_year(df: DataFrame, year: int | None) -> DataFrame:
    return df if year is None else date_range(df, dt.date(year, 1, 1), dt.date(year, 12, 31))


def in_month(df: DataFrame, month: str) -> DataFrame:
    first = dt.date.fromisoformat(month + "-01")
    following = (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    return date_range(df, first, following - dt.timedelta(days=1))


def in_fy(df: DataFrame, fy: int | None) -> DataFrame:
    if fy is None:
        return df
    return date_range(df, S.fy_start(fy), S.fy_end(fy))


def not_loan() -> Column:
    """NULL account types drop out as well."""
    return F.col("account_type") != "loan"


def not_transfer() -> Column:
    return ~F.col("is_transfer")


def exclusions(exclude_loans: bool = True, exclude_transfers: bool = True) -> Column:
    return all_of(not_loan() if exclude_loans else None, not_transfer() if exclude_transfers else None)


def category_is(name: str) -> Column:
    return F.col("category") == name


def account_is(name: str) -> Column:
    return F.col("account_name") == name


def search(text: str) -> Column:
    """Case-insensitive containment; ``%`` and ``_`` in the text stay wildcards."""
    literal_backslash = text.replace("\\", "\\\\")
    return F.col("description").ilike(f"%{literal_backslash}%")


def income() -> Column:
    return F.col("amount") > 0


def expense() -> Column:
    return F.col("amount") < 0


def business_category() -> Column:
    return F.col("category").startswith(BUSINESS_PREFIX)


def visible() -> Column:
    return F.col("display")


def spending_rows() -> Column:
    """On a category summary: expense categories that have a name other than the fallback one."""
    return (F.col("total") < 0) & ~F.col("category").eqNullSafe(UNCATEGORIZED)
