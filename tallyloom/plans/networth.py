"""Account and holding balances, net worth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.accounts import latest_balance
from tallyloom.plans.summaries import money_sum
from tallyloom.schema import TOTAL

#: fixed values: groups of the net worth panel
ACCOUNT_GROUPS = ("checking", "savings", "loan", "credit", "other")
ASSET_GROUPS = ("property", "vehicle", "shares", "super", "crypto")


def accounts_summary(txns: DataFrame, accounts: DataFrame, holdings: DataFrame) -> dict[str, DataFrame]:
    """Visible accounts with counts and balances, and the holdings with the value shown for each."""
    return {
        "accounts": latest_balance(txns, accounts).orderBy("account_type", "account_name"),
        "holdings": holdings.withColumn("current_value", F.coalesce("current_value", "cost_basis")).orderBy(
            "asset_type", "name"
        ),
    }


def net_worth(balances: DataFrame, holdings: DataFrame) -> DataFrame:
    """(section, item, amount): account groups, asset groups, cash, debt, holdings and their sum.

    Account types without a group count under 'other'; asset types without one only count in the total. Balances
    and holdings are first summed per type, so what follows handles a few rows.
    """
    kind = F.when(F.col("account_type").isin(*ACCOUNT_GROUPS), F.col("account_type")).otherwise("other")
    per_type = balances.groupBy(kind.alias("item")).agg(money_sum("balance").alias("amount"))
    by_type = per_type.select(F.lit("account").alias("section"), "item", "amount")
    value = F.coalesce("current_value", "cost_basis", F.lit(0))
    per_asset = holdings.groupBy(F.col("asset_type").alias("item")).agg(money_sum(value).alias("amount"))
    by_asset = per_asset.select(F.lit("asset").alias("section"), "item", "amount")
    rows = by_type.unionByName(by_asset)
    debt = (F.col("section") == "account") & F.col("item").isin("loan", "credit")
    part = (
        F.when(F.col("section") == "asset", "holdings").when(debt, "debt").otherwise("cash")
    )
    shown = (F.col("section") == "account") | F.col("item").isin(*ASSET_GROUPS)
    entries = F.array_compact(
        F.array(
            F.when(shown, F.struct("section", "item", "amount")),
            F.struct(F.lit("total").alias("section"), part.alias("item"), F.col("amount").alias("amount")),
            F.struct(F.lit("total").alias("section"), F.lit("net_worth").alias("item"), F.col("amount").alias("amount")),
        )
    )
    return rows.select(F.inline(entries)).groupBy("section", "item").agg(F.sum("amount").cast(TOTAL).alias("amount"))
