"""Financial-year reports: tax summary, sheets, rental and business schedules, the tax return.

Every figure of a return is a conditional sum, so the return is one aggregate over the year's rows, whatever the number
of properties, mappings and businesses; the configured figures are joined to that one row as literals.
"""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.config import Category, ExpenseMap, TaxConfig
from tallyloom.functions import predicates as P
from tallyloom.operators.accounts import with_accounts
from tallyloom.operators.lookup import config_frame
from tallyloom.operators.splits import compute_splits, split_amount, split_shares, with_computed_splits, with_splits
from tallyloom.plans.summaries import is_income, money_sum
from tallyloom.schema import MONEY, PCT, TOTAL

#: fixed values of the return
SALARY, INTEREST = "Salary", "Interest Income"
BUSINESS_INCOME = ("Freelance Income", "Other Income")
WITHHELD = "Tax withheld"
WFH_HOURS_PER_WEEK = Decimal(38)

LINE = "section string, item string, label string, amount decimal(28,2)"


def _money(value: Decimal | int) -> Column:
    return F.lit(str(value)).cast(TOTAL)


def _share(amount: Column, pct: Decimal) -> Column:
    factor = F.lit(str(pct)).cast(PCT) * F.lit("0.01").cast("decimal(3,2)")
    return F.round(amount.cast("decimal(26,2)") * factor, 2).cast(TOTAL)


# --- lists and sums of a financial year -------------------------------------------------------------------------------


def tax_category_summary(
    txns: DataFrame, categories: Iterable[Category], fy: int | None = None, accounts: DataFrame | None = None
) -> DataFrame:
    """Total and count per category, income first."""
    df = with_accounts(P.in_fy(txns, fy), accounts).where(P.exclusions())
    out = df.groupBy("category").agg(money_sum().alias("total"), F.count(F.lit(1)).alias("count"))
    out = out.select("category", is_income(categories).alias("is_income"), "total", "count")
    return out.orderBy(F.col("is_income").desc_nulls_last(), "total")


def business_transactions(txns: DataFrame, fy: int, accounts: DataFrame | None = None) -> DataFrame:
    """``Business:`` rows, loans included, in date order."""
    df = with_accounts(P.in_fy(txns, fy), accounts).where(P.business_category() & P.not_transfer())
    return df.orderBy("txn_date", "arrival").select("txn_date", "description", "amount", "category", "account_name")


def tax_summary(
    txns: DataFrame, categories: Iterable[Category], fy: int, accounts: DataFrame | None = None
) -> dict[str, DataFrame]:
    return {
        "categories": tax_category_summary(txns, categories, fy, accounts),
        "business_transactions": business_transactions(txns, fy, accounts),
    }


def income_by_category(
    txns: DataFrame, categories: Iterable[Category], fy: int, accounts: DataFrame | None = None
) -> DataFrame:
    names = [c.name for c in categories if c.is_income]
    df = with_accounts(P.in_fy(txns, fy), accounts).where(P.exclusions() & F.col("category").isin(*names))
    out = df.groupBy("category").agg(money_sum().alias("total"), F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.desc("total"))


def split_totals(splits: DataFrame) -> DataFrame:
    """Total and count per business of a splits frame; filter it to a year first."""
    return splits.groupBy("business").agg(
        money_sum("business_amount").alias("total"), F.count(F.lit(1)).alias("count")
    )


def _sheet(txns: DataFrame, accounts: DataFrame | None, fy: int, sign: Column) -> DataFrame:
    df = with_accounts(P.in_fy(txns, fy), accounts)
    return df.where(P.all_of(P.exclusions(), sign))


SHEET = ("txn_id", "txn_date", "description", "amount", "source_type", "category", "account_name")


def sheet_outgoing(
    txns: DataFrame, accounts: DataFrame | None, tax: TaxConfig, fy: int, splits: DataFrame | None = None
) -> DataFrame:
    """Expenses of a year with their splits; computed in the row, or taken from a (corrected) splits table."""
    df = _sheet(txns, accounts, fy, P.expense())
    df = with_computed_splits(df, tax) if splits is None else with_splits(df, splits)
    return df.orderBy("txn_date", "arrival").select(*SHEET, "splits", "biz_name", "biz_pct", "biz_amount")


def sheet_incoming(txns: DataFrame, accounts: DataFrame | None, fy: int) -> DataFrame:
    return _sheet(txns, accounts, fy, P.income()).orderBy("txn_date", "arrival").select(*SHEET)


def outgoing_totals(sheet: DataFrame) -> DataFrame:
    return sheet.agg(
        F.count(F.lit(1)).alias("count"),
        F.coalesce(money_sum(F.abs("amount")), F.lit(0).cast(TOTAL)).alias("total"),
        F.coalesce(money_sum(F.abs("biz_amount")), F.lit(0).cast(TOTAL)).alias("biz_total"),
    )


# --- one pass for all figures --------------------------------------------------------------------------------------


class _Figures:
    """Named conditional sums over the non-transfer rows of a financial year, evaluated by one aggregate."""

    def __init__(self) -> None:
        self._sums: dict[str, Column] = {}
        self._names: dict[tuple, str] = {}

    def total(self, key: tuple, value: Column) -> Column:
        name = self._names.setdefault(key, f"f{len(self._names)}")
        self._sums[name] = F.coalesce(F.sum(value).cast(TOTAL), F.lit(0).cast(TOTAL)).alias(name)
        return F.col(name)

    def category(self, name: str, loans: bool = True) -> Column:
        condition = F.col("category") == name
        condition = condition if loans else condition & P.not_loan()
        return self.total(("category", name, loans), F.when(condition, F.col("amount")))

    def tag(self, name: str) -> Column:
        return self.total(("tag", name), F.when(F.array_contains("tags", name), F.col("amount")))

    def mapped(self, mapping: ExpenseMap) -> Column:
        if mapping.category is not None:
            return F.abs(self.category(mapping.category))
        return F.abs(self.tag(mapping.tag)) if mapping.tag is not None else _money(0)

    def business(self, name: str, tax: TaxConfig) -> Column:
        share = F.filter(split_shares(tax.businesses), lambda s: s["business"] == name)
        pct = F.get(share, F.lit(0))["business_pct"]
        return self.total(("business", name), F.when(pct.isNotNull(), split_amount(F.col("amount"), pct)))

    def over(self, rows: DataFrame) -> DataFrame:
        columns = list(self._sums.values()) or [F.count(F.lit(1)).alias("n")]
        return rows.agg(*columns)


def _line(section: str, item: str, label: str, amount: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"),
        F.lit(item).alias("item"),
        F.lit(label).alias("label"),
        amount.cast(TOTAL).alias("amount"),
    )


def _depreciation(tax: TaxConfig, kind: str, owner: str, fy: int) -> list:
    return [d for d in tax.depreciation if d.kind == kind and d.owner == owner and d.fy == fy]


def _rental_lines(figures: _Figures, tax: TaxConfig, fy: int) -> list[Column]:
    lines = []
    for prop in tax.rental_properties:
        gross = figures.category(prop.income_category)
        share = _share(gross, prop.ownership_pct)
        lines.append(_line("rental", prop.name, "rental_weeks", _money(prop.rental_weeks.get(fy, 0))))
        lines.append(_line("rental", prop.name, "gross_income", gross))
        lines.append(_line("rental", prop.name, "income_share", share))
        spent = _money(0)
        for mapping in prop.expense_mapping:
            raw = figures.mapped(mapping)
            part = _share(raw, prop.ownership_pct)
            lines.append(_line("rental", prop.name, f"raw: {mapping.label}", raw))
            lines.append(_line("rental", prop.name, f"share: {mapping.label}", part))
            spent = spent + part
        for item in _depreciation(tax, "rental", prop.name, fy):
            lines.append(_line("rental", prop.name, f"depreciation: {item.description}", _money(item.amount)))
            spent = spent + _money(item.amount)
        lines.append(_line("rental", prop.name, "total_expenses", spent))
        lines.append(_line("rental", prop.name, "net_rent", share - spent))
    return lines


def _business_income(figures: _Figures) -> Column:
    first, second = BUSINESS_INCOME
    return figures.category(first) + figures.category(second)


def _business_lines(
    figures: _Figures, tax: TaxConfig, fy: int, expenses: dict[str, Column] | None = None
) -> list[Column]:
    lines = []
    for business in tax.businesses:
        income = _business_income(figures)
        spent = figures.business(business.name, tax) if expenses is None else expenses[business.name]
        written_off = sum((d.amount for d in _depreciation(tax, "business", business.name, fy)), Decimal(0))
        lines.append(_line("business", business.name, "income", income))
        lines.append(_line("business", business.name, "expenses", spent))
        lines.append(_line("business", business.name, "depreciation", _money(written_off)))
        lines.append(_line("business", business.name, "net", F.round(income + spent - _money(written_off), 2)))
    return lines


def _emit(figures: _Figures, rows: DataFrame, lines: list[Column]) -> DataFrame:
    if not lines:
        return rows.sparkSession.createDataFrame([], LINE)
    return figures.over(rows).select(F.inline(F.array(*lines)))


def _fy_rows(txns: DataFrame, fy: int) -> DataFrame:
    return P.in_fy(txns, fy).where(P.not_transfer())


def rental_schedule(txns: DataFrame, tax: TaxConfig, fy: int) -> DataFrame:
    """(section, item, label, amount) per property: gross, share, mapped expenses, depreciation, net. Loans included."""
    figures = _Figures()
    lines = _rental_lines(figures, tax, fy)
    return _emit(figures, _fy_rows(txns, fy), lines)


def business_schedule(txns: DataFrame, tax: TaxConfig, fy: int, splits: DataFrame | None = None) -> DataFrame:
    """Income (the same for every business), split expenses, depreciation and net per business.

    ``splits`` is a splits table of the year; without it the shares are computed from the rules in the same pass.
    """
    figures = _Figures()
    rows = _fy_rows(txns, fy)
    if splits is None:
        return _emit(figures, rows, _business_lines(figures, tax, fy))
    spent, one_row = _split_columns(splits, tax, fy)
    lines = _business_lines(figures, tax, fy, spent)
    return _combine(figures.over(rows), one_row).select(F.inline(F.array(*lines)))


def _split_columns(splits: DataFrame, tax: TaxConfig, fy: int) -> tuple[dict[str, Column], DataFrame]:
    names = {b.name: f"b{i}" for i, b in enumerate(tax.businesses)}
    sums = [
        F.coalesce(money_sum(F.when(F.col("business") == n, F.col("business_amount"))), F.lit(0).cast(TOTAL)).alias(c)
        for n, c in names.items()
    ]
    return {n: F.col(c) for n, c in names.items()}, P.in_fy(splits, fy).agg(*sums)


def _combine(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two frames of exactly one row each, side by side; the second is a scalar subquery, not a join."""
    return left.withColumn("_right", right.select(F.struct("*")).scalar()).select("*", "_right.*").drop("_right")


def wfh_amount(weeks: Column, allocation_pct: Column, rate: Column) -> tuple[Column, Column]:
    """Hours at home and the fixed-rate deduction."""
    hours = (
        weeks.cast("decimal(7,2)")
        * allocation_pct.cast(PCT)
        * F.lit("0.01").cast("decimal(3,2)")
        * F.lit(str(WFH_HOURS_PER_WEEK)).cast("decimal(4,0)")
    )
    return F.round(hours, 1).cast("decimal(10,1)"), F.round(hours * rate.cast("decimal(7,4)"), 2).cast(MONEY)


def wfh(entries: DataFrame) -> DataFrame:
    """Work-from-home deduction per row of (fy, weeks, allocation_pct, rate_per_hour), any number of holders."""
    hours, amount = wfh_amount(F.col("weeks"), F.col("allocation_pct"), F.col("rate_per_hour"))
    return entries.withColumns({"hours": hours, "amount": amount})


def wfh_frame(spark: SparkSession, tax: TaxConfig) -> DataFrame:
    rows = [(e.fy, e.weeks, e.allocation_pct, tax.wfh_rate) for e in tax.wfh_entries]
    return config_frame(
        spark, rows, "fy int, weeks decimal(7,2), allocation_pct decimal(7,4), rate_per_hour decimal(7,4)"
    )


def depreciation_frame(spark: SparkSession, tax: TaxConfig) -> DataFrame:
    rows = [(d.schedule, d.kind, d.owner, d.description, d.amount, d.fy) for d in tax.depreciation]
    return config_frame(
        spark, rows, "schedule string, kind string, owner string, description string, amount decimal(18,2), fy int"
    )


def depreciation_by_fy(items: DataFrame, fy: int | None = None) -> DataFrame:
    df = items if fy is None else items.where(F.col("fy") == fy)
    return df.groupBy("fy", "kind", "owner").agg(
        money_sum().alias("total"), F.count(F.lit(1)).alias("items")
    )


def work_trips(trips: DataFrame, expenses: DataFrame, fy: int | None = None) -> DataFrame:
    """Trips with total and per-type map of their expenses; 0 and an empty map without any.

    Expenses are summed per (trip, type) before they are gathered, so a trip's list has one entry per type.
    """
    by_type = expenses.groupBy("trip_id", "expense_type").agg(money_sum().alias("_total"))
    per_trip = by_type.groupBy("trip_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("expense_type", "_total")))).alias("by_type"),
        F.sum("_total").cast(TOTAL).alias("total"),
    )
    df = trips if fy is None else trips.where(F.col("fy") == fy)
    out = df.join(per_trip, "trip_id", "left")
    empty = F.create_map().cast("map<string,decimal(28,2)>")
    return out.withColumns(
        {"by_type": F.coalesce("by_type", empty), "total": F.coalesce("total", F.lit(0)).cast(TOTAL)}
    ).orderBy("start_date", "trip_id")


def by_prefixed_type() -> Column:
    """Expense sums of a trip by ``type: <name>``, so that a type named 'total' is not the total."""
    return F.transform_keys("by_type", lambda k, _: F.concat(F.lit("type: "), F.coalesce(k, F.lit(""))))


def tax_return(
    txns: DataFrame,
    tax: TaxConfig,
    fy: int,
    accounts: DataFrame | None = None,
    *,
    splits: DataFrame | None = None,
    trips: DataFrame | None = None,
    trip_expenses: DataFrame | None = None,
    overrides: DataFrame | None = None,
) -> DataFrame:
    """The whole return in long form (section, item, label, amount).

    A trip has its total and a line per expense type.
    Salary and interest leave loan accounts out, the schedules do not. Overrides are listed, not applied. The last
    manual entry named 'Tax withheld' counts.
    """
    figures = _Figures()
    rows = with_accounts(_fy_rows(txns, fy), accounts, "left")
    manual = [m for m in tax.manual_entries if m.fy == fy]
    withheld = [m.amount for m in manual if m.label == WITHHELD]
    lines = [
        _line("income", "", "salary", figures.category(SALARY, loans=False)),
        _line("income", "", "interest", figures.category(INTEREST, loans=False)),
        _line("income", "", "tax_withheld", _money(withheld[-1] if withheld else 0)),
        *_rental_lines(figures, tax, fy),
    ]
    one_row = None
    if splits is None:
        lines += _business_lines(figures, tax, fy)
    else:
        spent, one_row = _split_columns(splits, tax, fy)
        lines += _business_lines(figures, tax, fy, spent)
    entry = next((e for e in tax.wfh_entries if e.fy == fy), None)
    if entry is not None:
        weeks, pct, rate = (F.lit(str(v)) for v in (entry.weeks, entry.allocation_pct, tax.wfh_rate))
        _, amount = wfh_amount(weeks.cast("decimal(7,2)"), pct.cast(PCT), rate.cast("decimal(7,4)"))
        worked = (_money(entry.weeks), _money(entry.allocation_pct), amount)
    else:
        worked = (_money(0), _money(0), _money(0))
    lines += [_line("deduction", "wfh", n, v) for n, v in zip(("weeks", "allocation_pct", "amount"), worked, strict=True)]
    lines += [_line("manual", m.section, m.label, _money(m.amount)) for m in manual]
    if tax.spouse_name is not None:
        lines.append(_line("spouse", tax.spouse_name, "taxable_income", _money(tax.spouse_income or 0)))
    base = figures.over(rows)
    out = (base if one_row is None else _combine(base, one_row)).select(F.inline(F.array(*lines)))
    if trips is not None and trip_expenses is not None:
        per_trip = work_trips(trips, trip_expenses, fy)
        sums = F.map_concat(F.create_map(F.lit("total"), F.col("total")), by_prefixed_type())
        listed = per_trip.select(F.lit("work_trip").alias("section"), F.col("name").alias("item"), F.explode(sums).alias("label", "amount"))
        out = out.unionByName(listed)
    if overrides is not None:
        out = out.unionByName(
            overrides.where(F.col("fy") == fy).select(
                F.lit("override").alias("section"), F.col("section").alias("item"), "label", F.col("amount").cast(TOTAL).alias("amount")
            )
        )
    return out


def tax_lines(
    txns: DataFrame,
    categories: Iterable[Category],
    tax: TaxConfig,
    fy: int,
    accounts: DataFrame | None = None,
    splits: DataFrame | None = None,
) -> DataFrame:
    """The short summary: income by category, split totals by business, depreciation and manual entries."""
    spark = txns.sparkSession
    income = income_by_category(txns, categories, fy, accounts).select(
        F.lit("income").alias("section"), F.col("category").alias("item"), "count", F.col("total").alias("amount")
    )
    shares = compute_splits(txns, tax, fy) if splits is None else P.in_fy(splits, fy)
    business = split_totals(shares).select(
        F.lit("business").alias("section"), F.col("business").alias("item"), "count", F.col("total").alias("amount")
    )
    fixed = [("depreciation", d.description, 1, d.amount) for d in tax.depreciation if d.fy == fy]
    fixed += [("manual", m.label, 1, m.amount) for m in tax.manual_entries if m.fy == fy]
    configured = config_frame(spark, fixed, "section string, item string, count long, amount decimal(28,2)")
    return income.unionByName(business).unionByName(configured)
