"""Ordered lists of the small tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.config import Category, Rule, TagRule, TaxConfig
from tallyloom.operators.lookup import config_frame
from tallyloom.schema import CATEGORIES


def categories_frame(spark: SparkSession, categories: Iterable[Category]) -> DataFrame:
    return config_frame(spark, [(c.name, c.is_income, c.budget_monthly) for c in categories], CATEGORIES)


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [(i, r.kind, r.source_type, r.pattern, r.category) for i, r in enumerate(rules)]
    return config_frame(spark, rows, "ord int, kind string, source_type string, pattern string, category string")


def tag_rules_frame(spark: SparkSession, rules: Iterable[TagRule]) -> DataFrame:
    rows = [(i, r.tag, r.pattern, r.source_type) for i, r in enumerate(rules)]
    return config_frame(spark, rows, "ord int, tag string, pattern string, source_type string")


def businesses_frame(spark: SparkSession, tax: TaxConfig) -> DataFrame:
    rows = [(i, b.name, b.abn, b.activity) for i, b in enumerate(tax.businesses)]
    return config_frame(spark, rows, "ord int, business string, abn string, activity string")


def split_rules_frame(spark: SparkSession, tax: TaxConfig) -> DataFrame:
    rows = [
        (i, b.name, j, r.category, r.tag, r.business_pct)
        for i, b in enumerate(tax.businesses)
        for j, r in enumerate(b.split_rules)
    ]
    schema = "business_ord int, business string, ord int, category string, tag string, business_pct decimal(7,4)"
    return config_frame(spark, rows, schema)


def expense_map_frame(spark: SparkSession, tax: TaxConfig) -> DataFrame:
    rows = [
        (p.name, i, m.label, m.category, m.tag)
        for p in tax.rental_properties
        for i, m in enumerate(p.expense_mapping)
    ]
    return config_frame(spark, rows, "property string, ord int, label string, category string, tag string")


def list_categories(categories: DataFrame) -> DataFrame:
    return categories.orderBy("category")


def list_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.select("account_id", "account_name", "source_type", "currency", "account_type").orderBy("account_name")


def list_holdings(holdings: DataFrame) -> DataFrame:
    return holdings.orderBy("asset_type", "name")


def list_trips(trips: DataFrame, fy: int | None = None) -> DataFrame:
    df = trips if fy is None else trips.where(F.col("fy") == fy)
    return df.orderBy(F.col("fy").desc(), "start_date")


def list_overrides(overrides: DataFrame, fy: int | None = None) -> DataFrame:
    df = overrides if fy is None else overrides.where(F.col("fy") == fy)
    return df.orderBy(F.col("fy").desc(), "section", "label")
