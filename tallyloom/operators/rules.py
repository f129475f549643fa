"""Rules as literal expressions: payments to trusted accounts, categories, tags.

A rule list is configuration, so it is folded on the driver into one expression per outcome. Nothing is joined row by
row and no Python runs on the executors; a rule set costs one narrow pass and no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.config import TRANSFERS, UNCATEGORIZED, Account, Rule, Settings, TagRule, payment_patterns
from tallyloom.operators.lookup import hot_key_join

#: more outcomes than this are split over several columns, so that one generated method stays small enough to compile
CHUNK = 200
CONFIDENCE = "decimal(3,1)"

_PLAIN = re.compile(r"[A-Za-z0-9 _&/,:;'\"!@#%=<>~`-]+")
_BACKREF = re.compile(r"\\[1-9]|\(\?P[=<]")


def validate_patterns(spark: SparkSession, patterns: Iterable[str]) -> None:
    """Fail early, by name, on a pattern the executors could not compile: planning compiles each on the driver."""
    for pattern in patterns:
        try:
            re.compile(pattern)
            spark.range(1).select(F.lit("").rlike(_compiled(pattern)).alias("hit")).first()
        except Exception as error:
            raise ValueError(f"pattern {pattern!r} cannot be used: {error}") from error


def _compiled(pattern: str) -> str:
    """The pattern for upper-cased text: upper-cased itself where that is safe, else case-insensitive with Unicode classes."""
    if pattern.isascii() and "\\" not in pattern and "(?" not in pattern.replace("(?:", ""):
        return pattern.upper()
    return "(?iU)" + pattern


def matches(upper_text: Column, pattern: str) -> Column:
    """Unanchored case-insensitive search on upper-cased text.

    Alternatives without metacharacters become substring or prefix tests, which are byte searches; the rest stays a
    regular expression with Unicode classes.
    """
    tests: list[Column] = []
    rest: list[str] = []
    for part in _alternatives(pattern):
        anchored = part.startswith("^")
        body = part[1:] if anchored else part
        if body and _PLAIN.fullmatch(body):
            needle = F.lit(body.upper())
            tests.append(upper_text.startswith(needle) if anchored else upper_text.contains(needle))
        else:
            rest.append(part)
    if rest:
        tests.append(upper_text.rlike(_compiled("|".join(rest))))
    return reduce(lambda a, b: a | b, tests)


def _alternatives(pattern: str) -> list[str]:
    """Top-level alternatives where splitting is safe, else the whole pattern."""
    if any(ch in pattern for ch in "()[]\\{"):
        return [pattern]
    return pattern.split("|")


def _any_of(upper_text: Column, patterns: Sequence[str]) -> Column:
    if any(_BACKREF.search(p) for p in patterns):
        return reduce(lambda a, b: a | b, [matches(upper_text, p) for p in patterns])
    simple = [p for p in patterns if not any(ch in p for ch in "()[]\\{")]
    other = [p for p in patterns if p not in simple]
    tests = [matches(upper_text, "|".join(simple))] if simple else []
    if other:
        tests.append(upper_text.rlike(_compiled("|".join(f"(?:{p})" for p in other))))
    return reduce(lambda a, b: a | b, tests)


def payment_expr(accounts: Iterable[Account], text: Column | None = None) -> Column:
    """True where a record of an ordinary account pays a source-of-truth account, whose own records carry the detail."""
    patterns, trusted = payment_patterns(accounts)
    if not patterns:
        return F.lit(False)
    upper_text = F.upper(F.col("description")) if text is None else text
    hit = _any_of(upper_text, patterns)
    return hit & ~F.col("source_type").isin(*sorted(trusted)) if trusted else hit


def _fold(outcomes: list[tuple[Column, str]]) -> list[Column]:
    """First-match CASE over (condition, category), in chunks; each chunk is NULL where none of its conditions hold."""
    chunks = []
    for i in range(0, len(outcomes), CHUNK):
        expr = None
        for condition, category in outcomes[i : i + CHUNK]:
            expr = F.when(condition, category) if expr is None else expr.when(condition, category)
        chunks.append(expr)
    return chunks


def _source_outcomes(rules: Sequence[Rule]) -> list[tuple[Column, str]]:
    return [(F.col("source_type") == r.source_type, r.category) for r in rules if r.kind == "source"]


def _exact_outcomes(rules: Sequence[Rule], upper_text: Column) -> list[tuple[Column, str]]:
    return [(upper_text.contains(r.pattern.upper()), r.category) for r in rules if r.kind == "exact"]


def _regex_outcomes(rules: Sequence[Rule], upper_text: Column) -> list[tuple[Column, str]]:
    """Neighbouring rules with the same category and source filter share one test; first match is unaffected."""
    outcomes = []
    regex = [r for r in rules if r.kind == "regex"]
    for (category, source), run in groupby(regex, key=lambda r: (r.category, r.source_type or None)):
        condition = _any_of(upper_text, [r.pattern for r in run])
        if source:
            condition = (F.col("source_type") == source) & condition
        outcomes.append((condition, category))
    return outcomes


def rule_tiers(rules: Sequence[Rule], known: Iterable[str], upper_text: Column) -> list[tuple[Column, str]]:
    """(category or NULL, confidence) per tier: source 1.0, exact 0.9, regex 0.8.

    The tier beats the order in the file; a rule whose category is not defined is passed over.
    """
    names = set(known)
    usable = [r for r in rules if r.category in names]
    tiers = (
        (_source_outcomes(usable), "1.0"),
        (_exact_outcomes(usable, upper_text), "0.9"),
        (_regex_outcomes(usable, upper_text), "0.8"),
    )
    return [(chunk, confidence) for outcomes, confidence in tiers for chunk in _fold(outcomes)]


def first_category(tiers: Sequence[tuple[Column, str]]) -> Column:
    return F.coalesce(*[c for c, _ in tiers]) if tiers else F.lit(None).cast("string")


def first_confidence(tiers: Sequence[tuple[Column, str]]) -> Column:
    """Confidence of the first tier that decides; separate from the category, so reports that need one skip the other."""
    picks = [F.when(c.isNotNull(), F.lit(conf).cast(CONFIDENCE)) for c, conf in tiers]
    return F.coalesce(*picks) if picks else F.lit(None).cast(CONFIDENCE)


def tags_expr(rules: Sequence[TagRule], text: Column | None = None) -> Column:
    """All matching tags, each once, in configuration order."""
    if not rules:
        return F.array().cast("array<string>")
    upper_text = F.upper(F.col("description")) if text is None else text
    entries = []
    for (tag, source), run in groupby(rules, key=lambda r: (r.tag, r.source_type or None)):
        condition = _any_of(upper_text, [r.pattern for r in run])
        if source:
            condition = (F.col("source_type") == source) & condition
        entries.append(F.when(condition, tag))
    return F.array_distinct(F.array_compact(F.array(*entries)))


def _decisions(settings: Settings) -> dict[str, Column]:
    """What the rules alone decide: category and confidence (NULL where no rule matches), tags."""
    upper_text = F.upper(F.col("description"))
    transfers = F.lit(TRANSFERS if TRANSFERS in settings.category_names else None).cast("string")
    payment = payment_expr(settings.accounts, upper_text)
    tiers = rule_tiers(settings.rules, settings.category_names, upper_text)
    if TRANSFERS not in settings.category_names:
        # a payment without a category to go to still must not fall through to the rules
        return {
            "_category": F.when(~payment, first_category(tiers)),
            "_confidence": F.when(payment, F.lit("1.0").cast(CONFIDENCE)).otherwise(first_confidence(tiers)),
            "_payment": payment,
            "tags": tags_expr(settings.tag_rules, upper_text),
        }
    tiers = [(F.when(payment, transfers), "1.0"), *tiers]
    return {
        "_category": first_category(tiers),
        "_confidence": first_confidence(tiers),
        "_payment": F.lit(False),
        "tags": tags_expr(settings.tag_rules, upper_text),
    }


def _by_distinct_text(df: DataFrame, settings: Settings) -> DataFrame:
    """Evaluate the rules once per distinct (text, source); worth it only when the rules cost more than a shuffle."""
    keyed = df.withColumns({"_u": F.upper(F.col("description")), "_s": F.coalesce("source_type", F.lit(""))})
    pairs = keyed.select(F.col("_u").alias("description"), "source_type", "_u", "_s").distinct()
    decided = pairs.select("_u", "_s", *[c.alias(name) for name, c in _decisions(settings).items()])
    return hot_key_join(keyed, decided, ["_u", "_s"]).drop("_u", "_s")


def classify(
    df: DataFrame, settings: Settings, learned: DataFrame | None = None, distinct_text: bool = False
) -> DataFrame:
    """Add category, confidence, is_transfer and tags.

    Order: payment to a trusted account, then source, exact and regex rules, then the learned rules
    (``pattern`` = upper-cased description, ``category``), then Uncategorized.
    """
    names = settings.category_names
    out = _by_distinct_text(df, settings) if distinct_text else df.withColumns(_decisions(settings))
    learned_category = F.lit(None).cast("string")
    if learned is not None:
        known = learned.select(F.col("pattern").alias("_pattern"), F.col("category").alias("_learned"))
        out = hot_key_join(out.withColumn("_pattern", F.upper("description")), known, ["_pattern"])
        learned_category = F.when(~F.col("_payment"), F.col("_learned"))
    fallback = F.lit(UNCATEGORIZED if UNCATEGORIZED in names else None).cast("string")
    category = F.coalesce(F.col("_category"), learned_category, F.when(~F.col("_payment"), fallback))
    confidence = F.coalesce(
        F.col("_confidence"),
        F.when(learned_category.isNotNull(), F.lit("0.7").cast(CONFIDENCE)),
        F.lit("0.0").cast(CONFIDENCE),
    )
    out = out.withColumns({"category": category, "confidence": confidence})
    is_transfer = F.col("_payment") | F.coalesce(F.col("category") == TRANSFERS, F.lit(False))
    return out.withColumn("is_transfer", is_transfer).drop("_payment", "_category", "_confidence", "_pattern", "_learned")
