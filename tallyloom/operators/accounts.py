"""Accounts: which one a file belongs to, account columns on transactions, balances."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.config import Account
from tallyloom.functions.scalars import recorded_balance
from tallyloom.operators.lookup import config_frame, hot_key_join
from tallyloom.schema import ACCOUNTS, TOTAL

#: fixed values: account a source falls back to when no file prefix matches
DEFAULT_ACCOUNTS = {
    "paypal": "PayPal",
    "ing": "ING Orange Everyday",
    "airbnb": "Airbnb",
    "hsbc": "HSBC",
    "coles": "Coles Credit Card",
    "bankwest": "Bankwest",
    "amex": "Amex",
}


def accounts_frame(
    spark: SparkSession, accounts: Iterable[Account], defaults: Mapping[str, str] = DEFAULT_ACCOUNTS
) -> DataFrame:
    """Configured accounts, plus the fallback accounts of sources that are not configured."""
    rows = [(a.name, a.name, a.source_type, a.currency, a.account_type, a.display) for a in accounts]
    have = {r[0] for r in rows}
    rows += [(n, n, s, "AUD", "checking", True) for s, n in defaults.items() if n not in have]
    return config_frame(spark, rows, ACCOUNTS)


def resolve_account(
    accounts: Iterable[Account],
    defaults: Mapping[str, str] = DEFAULT_ACCOUNTS,
    file_name: Column | str = "file_name",
    source_type: Column | str = "source_type",
) -> Column:
    """Account of a file: the first configured prefix that fits, else the default of its source."""
    name = F.col(file_name) if isinstance(file_name, str) else file_name
    source = F.col(source_type) if isinstance(source_type, str) else source_type
    picked = None
    for account in accounts:
        if account.file_prefix is not None:
            condition = name.startswith(account.file_prefix)
            picked = F.when(condition, account.name) if picked is None else picked.when(condition, account.name)
    fallback = None
    for key, value in defaults.items():
        fallback = F.when(source == key, value) if fallback is None else fallback.when(source == key, value)
    choices = [c for c in (picked, fallback) if c is not None]
    return F.coalesce(*choices, source)


def resolve_account_by_table(records: DataFrame, prefixes: DataFrame) -> DataFrame:
    """As ``resolve_account`` for a prefix table (``prefix``, ``account_id``, ``ord``) too large to write as literals.

    Each distinct file name is expanded to its own leading parts and these are looked up by equality, so that no
    record meets a nested-loop join.
    """
    files = records.select("file_name").distinct()
    heads = files.withColumn("_len", F.explode(F.sequence(F.lit(0), F.length("file_name"))))
    heads = heads.select("file_name", F.substring("file_name", F.lit(1), F.col("_len")).alias("prefix"))
    best = heads.join(prefixes, "prefix").groupBy("file_name").agg(F.min_by("account_id", "ord").alias("account_id"))
    return hot_key_join(records, best, ["file_name"])


def with_accounts(txns: DataFrame, accounts: DataFrame | None, how: str = "inner") -> DataFrame:
    """Add account_name and account_type, unless the transactions carry them already."""
    if accounts is None or {"account_name", "account_type"} <= set(txns.columns):
        return txns
    return hot_key_join(txns, accounts.select("account_id", "account_name", "account_type"), ["account_id"], how)


def account_counts(txns: DataFrame, accounts: DataFrame) -> DataFrame:
    """Visible accounts with their number of transactions, 0 for none. Counts are made before the join."""
    counts = txns.groupBy("account_id").agg(F.count(F.lit(1)).alias("transaction_count"))
    out = accounts.where("display").join(counts, "account_id", "left")
    return out.withColumn("transaction_count", F.coalesce("transaction_count", F.lit(0)))


def latest_row(txns: DataFrame, *columns: str) -> DataFrame:
    """Per account the named columns of its newest record, by date then arrival.

    An aggregate, not a window: every task sends on one row per account it saw, so a hot account stays small.
    """
    newest = F.max_by(F.struct(*columns), F.struct("txn_date", "arrival")).alias("_latest")
    return txns.groupBy("account_id").agg(newest).select("account_id", "_latest.*")


def latest_balance(txns: DataFrame, accounts: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """Visible accounts with transaction count and balance.

    Balance: the one printed on the newest record, else the sum of all amounts. One aggregate per account over the
    transactions, then a join of per-account rows. The raw record comes from ``raw`` of ``txns``, or, where ``audit``
    (fy, dedup_hash, raw) is given, the newest record's identity is found first and only that record is looked up: the
    audit isn't joined to all transactions, and years without a newest record aren't read.
    """
    order = F.struct("txn_date", "arrival")
    newest = F.max_by("raw", order).alias("_raw") if audit is None else F.max_by(F.struct("fy", "dedup_hash"), order).alias("_key")
    per_account = txns.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.sum("amount").alias("_sum"), newest
    )
    if audit is not None:
        keyed = per_account.select("account_id", "transaction_count", "_sum", "_key.*")
        raw = audit.select("fy", "dedup_hash", F.col("raw").alias("_raw"))
        per_account = keyed.join(raw, ["fy", "dedup_hash"], "left").drop("fy", "dedup_hash")
    out = accounts.where("display").join(per_account, "account_id", "left")
    balance = F.coalesce(
        recorded_balance("_raw", "account_type").cast(TOTAL), F.col("_sum").cast(TOTAL), F.lit(0).cast(TOTAL)
    )
    return out.withColumns(
        {"balance": balance, "transaction_count": F.coalesce("transaction_count", F.lit(0))}
    ).drop("_sum", "_raw")
