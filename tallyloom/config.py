"""Configuration as plain Python objects, and the YAML files a user writes it in.

Configuration is written by hand and read once on the driver; rules become literal Column expressions, never a table
that is joined row by row.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from decimal import Decimal
from pathlib import Path
from typing import Any

import yaml

TRANSFERS = "Transfers"
UNCATEGORIZED = "Uncategorized"
BUSINESS_PREFIX = "Business:"


@dataclass(frozen=True)
class Account:
    name: str
    source_type: str
    currency: str = "AUD"
    account_type: str = "checking"
    display: bool = True
    file_prefix: str | None = None
    source_of_truth: bool = False
    payment_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Category:
    name: str
    is_income: bool = False
    budget_monthly: Decimal | None = None


@dataclass(frozen=True)
class Rule:
    """``kind`` is source, exact (a substring) or regex (optionally limited to one source)."""

    kind: str
    category: str
    pattern: str | None = None
    source_type: str | None = None


@dataclass(frozen=True)
class TagRule:
    tag: str
    pattern: str
    source_type: str | None = None


@dataclass(frozen=True)
class SplitRule:
    category: str
    tag: str | None
    business_pct: Decimal


@dataclass(frozen=True)
class Business:
    name: str
    abn: str = ""
    activity: str = ""
    split_rules: tuple[SplitRule, ...] = ()


@dataclass(frozen=True)
class ExpenseMap:
    label: str
    category: str | None = None
    tag: str | None = None


@dataclass(frozen=True)
class RentalProperty:
    name: str
    address: str = ""
    ownership_pct: Decimal = Decimal(100)
    rental_weeks: Mapping[int, int] = field(default_factory=dict)
    income_category: str = "Airbnb Income"
    expense_mapping: tuple[ExpenseMap, ...] = ()


@dataclass(frozen=True)
class DepreciationItem:
    schedule: str
    kind: str
    owner: str
    description: str
    amount: Decimal
    fy: int


@dataclass(frozen=True)
class WfhEntry:
    fy: int
    weeks: Decimal
    allocation_pct: Decimal


@dataclass(frozen=True)
class ManualEntry:
    fy: int
    label: str
    amount: Decimal
    section: str = ""
    notes: str = ""


@dataclass(frozen=True)
class TaxConfig:
    financial_year: int = 2025
    taxpayer: str = ""
    spouse_name: str | None = None
    spouse_income: Decimal | None = None
    businesses: tuple[Business, ...] = ()
    rental_properties: tuple[RentalProperty, ...] = ()
    depreciation: tuple[DepreciationItem, ...] = ()
    wfh_rate: Decimal = Decimal("0.67")
    wfh_entries: tuple[WfhEntry, ...] = ()
    manual_entries: tuple[ManualEntry, ...] = ()


@dataclass(frozen=True)
class Settings:
    accounts: tuple[Account, ...] = ()
    categories: tuple[Category, ...] = ()
    rules: tuple[Rule, ...] = ()
    tag_rules: tuple[TagRule, ...] = ()
    tax: TaxConfig = TaxConfig()

    @property
    def category_names(self) -> frozenset[str]:
        return frozenset(c.name for c in self.categories)

    @property
    def income_categories(self) -> list[str]:
        return [c.name for c in self.categories if c.is_income]


def _doc(path: str | Path) -> dict[str, Any]:
    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle) or {}


def _dec(value: Any) -> Decimal | None:
    return None if value is None else Decimal(str(value))


def load_accounts(path: str | Path) -> tuple[Account, ...]:
    return tuple(
        Account(
            name=a["name"],
            source_type=a["source_type"],
            currency=a.get("currency", "AUD"),
            account_type=a.get("account_type", "checking"),
            display=bool(a.get("display", 1)),
            file_prefix=a.get("file_prefix"),
            source_of_truth=bool(a.get("source_of_truth", False)),
            payment_patterns=tuple(a.get("payment_patterns") or ()),
        )
        for a in _doc(path).get("accounts") or ()
    )


def load_categories(path: str | Path) -> tuple[Category, ...]:
    return tuple(
        Category(c["name"], bool(c.get("is_income", False)), _dec(c.get("budget_monthly")))
        for c in _doc(path).get("categories") or ()
    )


def load_rules(path: str | Path) -> tuple[Rule, ...]:
    return tuple(
        Rule(r["type"], r["category"], r.get("pattern"), r.get("source_type")) for r in _doc(path).get("rules") or ()
    )


def load_tag_rules(path: str | Path) -> tuple[TagRule, ...]:
    return tuple(TagRule(r["tag"], r["pattern"], r.get("source_type")) for r in _doc(path).get("tag_rules") or ())


def load_tax(path: str | Path) -> TaxConfig:
    doc = _doc(path)
    spouse = (doc.get("taxpayer") or {}).get("spouse") or {}
    wfh = (doc.get("work_deductions") or {}).get("wfh") or {}
    return TaxConfig(
        financial_year=int(doc.get("financial_year", 2025)),
        taxpayer=(doc.get("taxpayer") or {}).get("name", ""),
        spouse_name=spouse.get("name"),
        spouse_income=_dec(spouse.get("taxable_income")),
        businesses=tuple(_business(b) for b in doc.get("businesses") or ()),
        rental_properties=tuple(_property(p) for p in doc.get("rental_properties") or ()),
        depreciation=tuple(_depreciation(doc.get("depreciation_schedules") or ())),
        wfh_rate=_dec(wfh.get("rate_per_hour", "0.67")),
        wfh_entries=tuple(
            WfhEntry(int(fy), _dec(e.get("weeks", 0)), _dec(e.get("allocation_pct", 0)))
            for fy, e in (wfh.get("entries") or {}).items()
        ),
        manual_entries=tuple(
            ManualEntry(int(fy), e["label"], _dec(e["amount"]), e.get("section", ""), e.get("notes", ""))
            for fy, entries in (doc.get("manual_entries") or {}).items()
            for e in entries
        ),
    )


def _business(b: Mapping[str, Any]) -> Business:
    rules = tuple(SplitRule(r["category"], r.get("tag"), _dec(r["business_pct"])) for r in b.get("split_rules") or ())
    return Business(b["name"], b.get("abn", ""), b.get("activity", ""), rules)


def _property(p: Mapping[str, Any]) -> RentalProperty:
    return RentalProperty(
        name=p["name"],
        address=p.get("address", ""),
        ownership_pct=_dec(p.get("ownership_pct", 100)),
        rental_weeks={int(k): int(v) for k, v in (p.get("rental_weeks") or {}).items()},
        income_category=p.get("income_category", "Airbnb Income"),
        expense_mapping=tuple(
            ExpenseMap(m["ato_label"], m.get("category"), m.get("tag")) for m in p.get("expense_mapping") or ()
        ),
    )


def _depreciation(schedules: Iterable[Mapping[str, Any]]) -> Iterable[DepreciationItem]:
    for s in schedules:
        owner = s.get("property") if s.get("type") == "rental" else s.get("business")
        for item in s.get("items") or ():
            yield DepreciationItem(
                s["name"], s.get("type", ""), owner or "", item["description"], _dec(item["amount"]), int(item["fy"])
            )


def load_settings(accounts: str | Path, categories: str | Path, tax: str | Path | None = None) -> Settings:
    return Settings(
        accounts=load_accounts(accounts),
        categories=load_categories(categories),
        rules=load_rules(categories),
        tag_rules=load_tag_rules(categories),
        tax=load_tax(tax) if tax else TaxConfig(),
    )


def payment_patterns(accounts: Iterable[Account]) -> tuple[list[str], set[str]]:
    """Patterns that mark a payment to a source-of-truth account, and the source types of those accounts."""
    trusted = [a for a in accounts if a.source_of_truth]
    return [p for a in trusted for p in a.payment_patterns], {a.source_type for a in trusted}
