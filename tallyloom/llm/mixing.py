"""A mix of sources to target weights, by a low-discrepancy schedule.

The mix is a row of 2^m slots. Slot k has the van der Corput point of k (its m bits, reversed, as a fraction), and the
point falls into the share of one source on the unit interval, so that every stretch of the mix holds the sources close
to their shares, and each source gets the slots of its share to within one. Slots are ranked per source. A source's
documents, in shuffled order, form a stream that is repeated as often as needed; its target is cut into as many blocks
of equal words (to within one) as it has slots, and the block of a rank is joined to the slot of that rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.scan import along
from tallyloom.operators.lookup import hot_key_join
from tallyloom.session import written

WORD = r"[^\x20\x09-\x0D]+"
#: weights of the sources in order of their names, repeated
WEIGHTS = (1, 2, 3)
#: how often a document may be taken at most
MOST_REPEATS = 3
#: words of a slot at most, before a source's target is divided among its slots
SLOT_WORDS = 512
#: points of a share that one row stands for before they are spread over tasks
STRETCH = 4096
#: a number that all weights divide, which makes the order of size by weight one of integers
_MULTIPLE = 6


def words_of(text: Column) -> Column:
    """Number of runs of other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, the source as a key without nulls (``named``, ``source``), and a shuffling key."""
    named = F.col("source").isNotNull()
    size = words_of(F.col("text"))
    key = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), size.cast("string")).cast("binary"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), named.alias("named"), F.coalesce("source", F.lit("")).alias("source"), size.alias("size"), key.alias("shuffled")
    )


def targets(sizes: DataFrame) -> DataFrame:
    """named, source, source_size, target, words (the target as a whole number), and the source's part of the unit interval, lo to hi.

    Weights follow the order of names, the unnamed source last. With all sources in order of size by weight, those that
    stop at ``MOST_REPEATS`` times their size come first, and what they leave is shared by weight among the others: the
    first source whose share of what is left is no more than its limit decides. Sums are exact integers, sources are
    ordered by ranges, so their number is not bounded.
    """
    per_source = sizes.groupBy("named", "source").agg(F.sum("size").cast("long").alias("source_size"))
    per_source = per_source.withColumns({"all": F.lit(1), "last": ~F.col("named")})
    numbered = along(written(per_source, "sources"), ["all"], ["last", "source"], "nth")
    weight = F.array(*[F.lit(w) for w in WEIGHTS])
    weighed = numbered.withColumn("weight", F.get(weight, (F.col("nth") % len(WEIGHTS)).cast("int")).cast("long"))
    limited = weighed.withColumns(
        {"limit": MOST_REPEATS * F.col("source_size"), "ratio": (F.col("source_size") * _MULTIPLE / F.col("weight")).cast("long")}
    )
    limited = written(limited, "limits")
    ordered = along(limited, ["all"], ["ratio", "nth"], "by_ratio", {"limits": ("sum", "limit"), "weights": ("sum", "weight")})
    total, weighs = limited.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    wide = "decimal(38,0)"
    left, over = F.lit(total).cast("long") - F.col("limits") + F.col("limit"), F.lit(weighs).cast("long") - F.col("weights") + F.col("weight")
    free = (left.cast(wide) * F.col("weight")) <= (F.col("limit").cast(wide) * over)
    first = ordered.where(free).agg(F.min(F.struct("by_ratio", left.alias("left"), over.alias("over")))).first()[0]
    if first is None:  # no source at all
        first = {"by_ratio": 0, "left": 0, "over": 1}
    is_free = F.col("by_ratio") >= F.lit(first["by_ratio"])

    def shared(weights: Column) -> Column:
        return (weights * F.lit(first["left"])).cast("double") / F.lit(float(first["over"]))

    def upto(limits: Column, weights: Column) -> Column:
        """What sources take up to a place in the order of ratios: the same number as the end of one and the start of the next."""
        taken_freely = F.lit(float(total - first["left"])) + shared(weights - F.lit(weighs - first["over"]))
        return F.when(is_free, taken_freely).otherwise(limits.cast("double")) / F.lit(float(max(total, 1)))

    target = F.when(is_free, shared(F.col("weight"))).otherwise(F.col("limit").cast("double"))
    return ordered.select(
        "named",
        "source",
        "source_size",
        target.alias("target"),
        F.floor(target + 0.5).cast("long").alias("words"),
        upto(F.col("limits") - F.col("limit"), F.col("weights") - F.col("weight")).alias("lo"),
        upto(F.col("limits"), F.col("weights")).alias("hi"),
    )


def reversed_bits(value: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of a long in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(value), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def schedule(shares: DataFrame, slot_words: int = SLOT_WORDS) -> DataFrame:
    """slot, source key, rank, n (slots of the source): the slots of all sources with words.

    The points of a share are a stretch of the grid of 2^-m, so those of a source are listed from its ends, in stretches
    that are spread over tasks. A source whose share holds no point has one slot at the next point.
    """
    total = shares.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    bits = max(0, (total // slot_words).bit_length() - 1)
    n = 1 << bits

    ends = {end: F.least(F.ceil(F.col(end) * n), F.lit(n)).cast("long") for end in ("lo", "hi")}
    held = shares.where("words > 0").withColumns(ends)
    held = held.withColumns({"lo": F.least("lo", F.lit(n - 1)), "n": F.greatest(F.col("hi") - F.col("lo"), F.lit(1))})
    stretches = held.select("named", "source", "n", "lo", F.explode(F.expr(f"sequence(0L, (n - 1) div {STRETCH})")).alias("stretch")).repartition(
        "named", "source", "stretch"
    )
    last = F.least(F.col("n"), (F.col("stretch") + 1) * STRETCH) - 1
    points = stretches.select("named", "source", "n", F.explode(F.sequence(F.col("lo") + F.col("stretch") * STRETCH, F.col("lo") + last)).alias("point"))
    slots = points.select("named", "source", "n", reversed_bits(F.col("point"), bits).alias("slot"))
    return along(written(slots, "slots"), ["named", "source"], ["slot"], "rank")


def _block_of(word: Column) -> Column:
    """Rank of the block that holds a word of the source's target. The first ``longer`` blocks have a word more than ``short``."""
    in_longer = F.col("longer") * (F.col("short") + 1)
    late = F.col("longer") + F.floor((word - in_longer) / F.col("short"))
    return F.when(word < in_longer, F.floor(word / (F.col("short") + 1))).otherwise(late).cast("long")


def _begin_of(rank: Column) -> Column:
    return rank * F.col("short") + F.least(rank, F.col("longer"))


def mix(docs: DataFrame, slot_words: int = SLOT_WORDS) -> DataFrame:
    """named, source, place, doc_id, size, source_size, target, slot, repeat, start, length: the pieces of the mix, and a row for each document that has none.

    Read in order of slot, then the piece's place in the block (``at``), they are the mix. ``start`` and ``length`` count
    words of the document; ``repeat`` counts from 0. A document without words has no piece, so ``slot`` is null; null texts
    count as empty. Null doc_ids are documents like any other, repeated rows are documents of their own, and a null
    source is one, after all others. Nothing is in the mix if no document has a word. Other columns are not carried on.

    Words taken of a source are its target, rounded; none of its documents is taken more than ``MOST_REPEATS`` times.
    """
    sizes = written(sized(docs), "sizes")
    shares = written(targets(sizes), "shares")
    stream = along(sizes, ["named", "source"], ["shuffled", "doc_id", "size"], "place", {"upto": ("sum", "size")})
    slots = schedule(shares, slot_words)
    counts = slots.groupBy("named", "source").agg(F.max("n").alias("n"))
    facts = shares.join(counts, ["named", "source"], "left").withColumns({"short": F.floor(F.col("words") / F.col("n")), "longer": F.col("words") % F.col("n")})
    known = hot_key_join(stream, facts, ["named", "source"], "inner", salted=False)
    # where the document stands in each repeat of its source's stream, as far as the target reaches
    repeats = F.transform(
        F.array(*[F.lit(r).cast("long") for r in range(MOST_REPEATS)]),
        lambda r: F.struct(
            r.alias("repeat"),
            (r * F.col("source_size") + F.col("upto") - F.col("size")).alias("begin"),
            F.least(r * F.col("source_size") + F.col("upto"), F.col("words")).alias("end"),
        ),
    )
    taken = known.withColumn("span", F.explode_outer(F.filter(repeats, lambda s: s["begin"] < s["end"])))
    spans = taken.select("*", "span.*").drop("span").withColumns({"first": _block_of(F.col("begin")), "final": _block_of(F.col("end") - 1)})
    cut = spans.withColumn("rank", F.explode_outer(F.sequence("first", "final")))
    block, after = _begin_of(F.col("rank")), _begin_of(F.col("rank") + 1)
    low, high = F.greatest("begin", block), F.least("end", after)
    offset = F.col("repeat") * F.col("source_size") + F.col("upto") - F.col("size")
    pieces = cut.select(
        "named", "source", "place", "doc_id", "size", "source_size", "target", "repeat", "rank",
        (low - offset).alias("start"), (high - low).alias("length"), (low - block).alias("at"),
    )
    return pieces.join(slots.select("named", "source", "rank", "slot"), ["named", "source", "rank"], "left").drop("rank")


def taken(docs: DataFrame, slot_words: int = SLOT_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document, its words in the scheduled blocks counted."""
    pieces = mix(docs, slot_words)
    scheduled = F.when(F.col("slot").isNotNull(), F.col("length"))
    one = pieces.groupBy("named", "source", "place").agg(
        *[F.first(n).alias(n) for n in ("doc_id", "size", "source_size", "target")], F.coalesce(F.sum(scheduled), F.lit(0)).cast("long").alias("taken")
    )
    return one.select("doc_id", "size", "source_size", "target", "taken")
