"""Quality rules with thresholds that follow the data.

Four figures of every document are summed up per language and source in a mergeable quantile sketch: a histogram of
integer buckets that keep the leading eight bits of a value, so that sketches merge by adding counts, in any order and
with equal results, and a quantile is off by less than one part in 128. Thresholds are fences: a quantile of the group's
sketch and, beyond it, a multiple of the distance between two of its quantiles. No fixed value bounds them. Groups with few
documents use the sketch of their language, and languages with few that of all documents.
Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import SPACE
from tallyloom.operators.lookup import hot_key_join
from tallyloom.session import written

MIN_WORDS = 50
#: documents that a sketch needs to set thresholds of its own
MIN_GROUP = 200
#: a fence is a quantile plus this many times its distance from a lower one
SPREAD = 3
#: the two quantiles of each figure, in hundredths: quartiles where a fault shows in a minority of documents that stand apart,
#: the uppermost hundredth where many sound documents have a little of it
QUANTILES = {"symbols": (75, 25), "dup_lines": (99, 75), "repeats": (99, 75), "word_length": (75, 25)}
#: what the shares are shares of, and how many occurrences more than the fence allows are no fault: in short texts one or two make a large share
SHARES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
SLACK = 2
TWO_SIDED = ("word_length",)
NULL_KEY = "\x00"
WORD = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more.

    Windows are sorted by the upper bits of their hash, the lower bits hold the place. Neighbours with equal hashes are
    compared as text.
    """
    n = F.size(words)
    hashes = F.transform(F.slice(words, F.lit(1), n - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        bits = F.length(F.bin(F.size(h).cast("long")))

        def hash_of(x: Column) -> Column:
            return F.call_function("shiftright", x, bits)

        def twins(s: Column, same: Callable[[Column, Column], Column]) -> Column:
            return F.filter(
                s, lambda x, i: F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False))
            )

        packed = F.transform(h, lambda x, i: F.call_function("shiftleft", hash_of(x), bits).bitwiseOR(i.cast("long")))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        alike = let(F.sort_array(packed), lambda s: twins(s, lambda a, b: hash_of(a) == hash_of(b)))

        def window(p: Column) -> Column:
            i = p.cast("int")
            return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

        places = F.transform(alike, lambda x: let(x.bitwiseAND(mask), lambda p: F.struct(window(p).alias("w"), p.alias("p"))))
        equal = let(F.sort_array(places), lambda s: twins(s, lambda a, b: a["w"] == b["w"]))
        at = F.sort_array(F.transform(equal, lambda x: x["p"]))
        gaps = let(at, lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(3).cast("long"), b - a)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    none = F.lit(0).cast("long")
    return F.when(n < 4, none).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)))
    )


def base_figures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every whole text; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    )
    return docs.select(
        "doc_id",
        F.coalesce("lang", F.lit(NULL_KEY)).alias("lang"),
        F.coalesce("source", F.lit(NULL_KEY)).alias("source"),
        of_words.alias("w"),
        of_lines.alias("x"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    ).select("doc_id", "lang", "source", "w.*", "x.*", "n_symbols")


def _figures() -> dict[str, Column]:
    """The four figures as integers: shares in thousandths, mean word length in hundredths."""

    def share(a: str, b: str, scale: int) -> Column:
        return F.expr(f"({scale} * {a}) div greatest({b}, 1L)")

    return {n: share(a, b, 1000) for n, (a, b) in SHARES.items()} | {"word_length": share("word_chars", "n_words", 100)}


def bucket(value: str) -> Column:
    """The value with only its leading eight bits kept."""
    step = F.expr(f"shiftleft(1L, greatest(length(bin({value})) - 8, 0))")
    return F.col(value) - F.col(value) % step


def sketches(figures: DataFrame) -> DataFrame:
    """lang, source, figure, bucket, n of documents that pass the base rules. Sketches of unions are sums of these."""
    names = list(_figures())
    rows = figures.where("not base_failed").select("lang", "source", F.explode(F.array(*[F.struct(F.lit(n).alias("figure"), F.col(n).alias("value")) for n in names])).alias("f"))
    return rows.select("lang", "source", "f.*").groupBy("lang", "source", "figure", bucket("value").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """low, high of each figure as columns, one row per key, from quantiles of the sketch; and how many documents it holds."""
    merged = sketch.groupBy(*keys, "figure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "figure")
    counted = merged.withColumn("below", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    ranks = sorted({q for pair in QUANTILES.values() for q in pair})
    quantile = {q: F.min(F.when(F.col("below") * 100 >= F.col("total") * q, F.col("bucket"))) for q in ranks}
    per = counted.groupBy(*keys, "figure").agg(*[c.alias(f"q{q}") for q, c in quantile.items()], F.max("total").alias("total"))
    high, low = F.lit(None).cast("long"), F.lit(None).cast("long")
    for name, (up, down) in QUANTILES.items():
        apart = SPREAD * (F.col(f"q{up}") - F.col(f"q{down}"))
        high = F.when(F.col("figure") == name, F.col(f"q{up}") + apart).otherwise(high)
        low = F.when(F.col("figure") == name, F.col(f"q{down}") - apart).otherwise(low)
    per = per.withColumns({"high": high, "low": low})
    columns = [F.max(F.when(F.col("figure") == n, F.col(side))).alias(f"{n}_{side}") for n in QUANTILES for side in ("low", "high")]
    return per.groupBy(*keys).agg(*columns, F.max("total").alias("total"))


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """lang, source and the fences that hold there: the group's own, its language's, or those of all documents."""
    names = [f"{n}_{side}" for n in QUANTILES for side in ("low", "high")]
    own = _fences(sketch, ["lang", "source"])
    language = _fences(sketch, ["lang"])
    overall = _fences(sketch.withColumn("every", F.lit(1)), ["every"])

    def named(df: DataFrame, prefix: str) -> list[Column]:
        return [F.col(n).alias(f"{prefix}{n}") for n in (*names, "total") if n in df.columns]

    joined = own.join(language.select("lang", *named(language, "l_")), "lang")
    joined = joined.withColumn("_all", overall.select(F.struct(*named(overall, "o_"))).scalar()).select("*", "_all.*")

    def picked(n: str) -> Column:
        return F.when(F.col("total") >= min_group, F.col(n)).when(F.col("l_total") >= min_group, F.col(f"l_{n}")).otherwise(F.col(f"o_{n}")).alias(n)

    return joined.select("lang", "source", *[picked(n) for n in names])


def apply_rules(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept: a row per input row.

    Null and empty texts have no words and fail the base rules. Null languages and sources are groups of their own. Repeated
    rows count each time. Figures are computed once and written to the shared folder; texts are not shuffled.
    """
    figures = base_figures(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    figures = written(figures.withColumns({**_figures(), "base_failed": failed}), "figures")
    limits = thresholds(sketches(figures), min_group)
    joined = hot_key_join(figures, limits, ["lang", "source"], "left", salted=True)
    inside = [1000 * F.col(a) <= F.col(f"{n}_high") * F.col(b) + 1000 * SLACK for n, (a, b) in SHARES.items()]
    inside += [F.col(n).between(F.col(f"{n}_low"), F.col(f"{n}_high")) for n in TWO_SIDED]
    kept = ~F.col("base_failed") & F.coalesce(reduce(lambda a, b: a & b, inside), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
