from __future__ import annotations

import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallyloom.config import (  # noqa: E402
    Account,
    Business,
    Category,
    Rule,
    Settings,
    SplitRule,
    TagRule,
    TaxConfig,
)
from tallyloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, app="tests", memory="6g")


@pytest.fixture(scope="session")
def settings() -> Settings:
    income = ("Salary", "Airbnb Income", "Freelance Income", "Interest Income")
    other = (
        "Business: Hosting",
        "Business: Software",
        "Groceries",
        "Eating Out",
        "Public Transport",
        "Subscriptions",
        "Utilities",
        "Transfers",
        "Uncategorized",
    )
    return Settings(
        accounts=(
            Account("Checking", "ing", file_prefix="my_checking"),
            Account("Joint", "ing", file_prefix="my_joint"),
            Account("PayPal", "paypal", account_type="other", source_of_truth=True, payment_patterns=("PAYPAL",)),
            Account("Card", "coles", account_type="credit", source_of_truth=True, payment_patterns=("MY CREDIT CARD",)),
            Account("HSBC", "hsbc", account_type="credit", source_of_truth=True, payment_patterns=("HSBC CARDS",)),
        ),
        categories=tuple(Category(n, True) for n in income)
        + tuple(Category(n, False, Decimal(600) if n == "Groceries" else None) for n in other),
        rules=(
            Rule("source", "Airbnb Income", source_type="airbnb"),
            Rule("regex", "Business: Hosting", "RACK ?HARBOUR"),
            Rule("regex", "Business: Software", r"PIXELDESK|QUILL.?LANE|\bINVOICER\b"),
            Rule("regex", "Salary", "^PAYROLL"),
            Rule("regex", "Not defined", "WOOLWORTHS"),
            Rule("regex", "Transfers", "TRANSFER TO|BPAY|INTERNAL TRANSFER"),
            Rule("regex", "Groceries", "WOOLWORTHS|ALDI"),
            Rule("regex", "Public Transport", "^CITY FERRY|^METROCARD"),
            Rule("exact", "Subscriptions", "cinebox"),
            Rule("regex", "Eating Out", r"\bCAF[EÉ]\b"),
        ),
        tag_rules=(
            TagRule("mobile", "WAVEPHONE|FIBREFONE"),
            TagRule("internet", "FIBREFONE"),
            TagRule("biz", "PIXELDESK|RACK ?HARBOUR"),
            TagRule("deductible", "RACK ?HARBOUR"),
            TagRule("biz", "QUILL.?LANE"),
        ),
        tax=TaxConfig(
            financial_year=2025,
            businesses=(
                Business(
                    "First Pty",
                    split_rules=(
                        SplitRule("Utilities", "internet", Decimal(2)),
                        SplitRule("Utilities", "mobile", Decimal(3)),
                        SplitRule("Groceries", None, Decimal(90)),
                    ),
                ),
                Business("Second Pty", split_rules=(SplitRule("Utilities", "mobile", Decimal(10)),)),
            ),
        ),
    )


@pytest.fixture(scope="session")
def make_records(spark):
    """RAW_TXN records from short tuples (description, amount, source_type, source_file, reference_id, date)."""
    from pyspark.sql import functions as F

    from tallyloom.schema import RAW_TXN

    def make(*rows):
        defaults = ("", "-50.00", "ing", "test.pdf", None, "2025-06-15")
        full = [(*r, *defaults[len(r) :]) for r in rows]
        df = spark.createDataFrame(
            [(i, *r) for i, r in enumerate(full)],
            "seq long, description string, amount string, source_type string, source_file string, reference_id string, day string",
        )
        out = df.select(
            F.to_date("day").alias("txn_date"),
            F.col("day").alias("date_raw"),
            "description",
            F.col("amount").cast("decimal(18,2)").alias("amount"),
            F.lit("AUD").alias("currency"),
            F.lit(None).cast("decimal(18,2)").alias("original_amount"),
            F.lit(None).cast("string").alias("original_currency"),
            F.lit(0).cast("decimal(18,2)").alias("fee"),
            "reference_id",
            "source_type",
            "source_file",
            F.create_map(F.lit("n"), F.col("seq").cast("string")).alias("raw"),
            F.struct(
                F.lit(0).alias("source_rank"), F.lit("f").alias("file_name"), F.lit(0).cast("long").alias("block"), "seq"
            ).alias("arrival"),
        )
        return out.select(*RAW_TXN.names)

    return make
