"""Business shares of transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.config import BUSINESS_PREFIX, Business, TaxConfig
from tallyloom.functions import predicates as P
from tallyloom.schema import MONEY, PCT


def split_amount(amount: Column | str, pct: Column | str) -> Column:
    """round(amount * pct / 100, 2), half up on decimals."""
    a = F.col(amount) if isinstance(amount, str) else amount
    p = F.col(pct) if isinstance(pct, str) else pct
    share = a.cast("decimal(18,2)") * p.cast("decimal(7,4)") * F.lit("0.01").cast("decimal(3,2)")
    return F.round(share, 2).cast(MONEY)


def split_shares(businesses: tuple[Business, ...]) -> Column:
    """array<struct<business, business_ord, business_pct>> of one transaction, by ``category`` and ``tags``.

    A ``Business:`` category goes whole to the first business. Otherwise each business takes its first rule whose
    category is the same and whose tag is present; a rule without a tag never applies.
    """
    share = "struct<business:string,business_ord:int,business_pct:decimal(7,4)>"
    entries = []
    for ord_, business in enumerate(businesses):
        pct = None
        if ord_ == 0:
            pct = F.when(F.col("category").startswith(BUSINESS_PREFIX), F.lit(100).cast(PCT))
        for rule in business.split_rules:
            if rule.tag is None or rule.category.startswith(BUSINESS_PREFIX):
                continue
            condition = (F.col("category") == rule.category) & F.array_contains("tags", rule.tag)
            value = F.lit(str(rule.business_pct)).cast(PCT)
            pct = F.when(condition, value) if pct is None else pct.when(condition, value)
        if pct is not None:
            entry = F.struct(
                F.lit(business.name).alias("business"), F.lit(ord_).alias("business_ord"), pct.alias("business_pct")
            )
            entries.append(F.when(pct.isNotNull(), entry))
    return F.array_compact(F.array(*entries)) if entries else F.array().cast(f"array<{share}>")


def compute_splits(txns: DataFrame, tax: TaxConfig, fy: int | None = None) -> DataFrame:
    """Splits of all non-transfer transactions (loans included), one row per transaction and business. No shuffle."""
    keys = [c for c in ("txn_id", "txn_date", "fy", "arrival", "amount") if c in txns.columns]
    rows = P.in_fy(txns, fy).where(~F.col("is_transfer")).select(*keys, F.explode(split_shares(tax.businesses)).alias("s"))
    return rows.select(*keys, "s.business", "s.business_ord", "s.business_pct").withColumn(
        "business_amount", split_amount("amount", "business_pct")
    )


def with_splits(txns: DataFrame, splits: DataFrame) -> DataFrame:
    """Attach the splits of a table to their transactions, in configuration order, with the first one as flat columns.

    Both sides carry at most a few rows per transaction, so neither the grouping nor the join can meet a hot key.
    """
    entry = F.struct("business_ord", "business", "business_pct", "business_amount")
    grouped = splits.groupBy("txn_id").agg(F.array_sort(F.collect_list(entry)).alias("splits"))
    return first_split(txns.join(grouped, "txn_id", "left"))


def with_computed_splits(txns: DataFrame, tax: TaxConfig) -> DataFrame:
    """As ``with_splits`` with the splits the rules give, computed in the row: no shuffle at all."""
    entries = F.transform(
        split_shares(tax.businesses),
        lambda s: F.struct(
            s["business_ord"].alias("business_ord"),
            s["business"].alias("business"),
            s["business_pct"].alias("business_pct"),
            split_amount(F.col("amount"), s["business_pct"]).alias("business_amount"),
        ),
    )
    return first_split(txns.withColumn("splits", F.when(~F.col("is_transfer"), entries)))


def first_split(df: DataFrame) -> DataFrame:
    entry = "array<struct<business_ord:int,business:string,business_pct:decimal(7,4),business_amount:decimal(18,2)>>"
    df = df.withColumn("splits", F.coalesce(F.col("splits"), F.array().cast(entry)))
    first = F.get("splits", F.lit(0))
    return df.withColumns(
        {
            "biz_name": F.coalesce(first["business"], F.lit("")),
            "biz_pct": F.coalesce(first["business_pct"], F.lit(0).cast(PCT)),
            "biz_amount": F.coalesce(first["business_amount"], F.lit(0).cast(MONEY)),
        }
    )
