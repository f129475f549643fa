"""Bank, card, payment and rental-platform CSV exports. Each reader is cells -> RAW_TXN plus a reject reason."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators.conversions import collapse_conversions
from tallyloom.schema import MONEY
from tallyloom.sources import cells as C

# fixed values: column names and layouts of the exports
ING_HEADER = C.HeaderRule(("Date", "Description", "Credit", "Debit"))
BANKWEST_HEADER = C.HeaderRule(("Transaction Date", "Narration", "Debit", "Credit"))
AMEX_HEADER = C.HeaderRule(("Date", "Description", "Amount"))
PAYPAL_HEADER = C.HeaderRule(("Date", "Currency", "Gross", "Transaction ID"))


def _simple(
    rows: DataFrame,
    date: str,
    text: str,
    amounts: tuple[str, ...],
    amount: Callable[..., Column],
    source_type: str,
    rank: int,
    foreign: str | None = None,
) -> DataFrame:
    """Records of a plain layout: rows without a date, a description or an amount are not transactions.

    ``amount`` is made of the values of the columns ``amounts``; a blank or zero one is none, and text that is no number sends the
    row to quarantine. ``foreign`` names a column with the foreign amount.
    """
    numbers = [*amounts, *([foreign] if foreign else [])]
    texts = F.struct(
        C.field(date).alias("date_text"), F.trim(C.field(text)).alias("text"), *[C.field(n).alias(f"n{i}") for i, n in enumerate(numbers)]
    )

    def values(t: Column) -> Column:
        return F.struct(
            t["date_text"].alias("date_text"),
            t["text"].alias("text"),
            S.parse_dmy(t["date_text"]).alias("parsed"),
            *[S.parse_amount_lenient(t[f"n{i}"]).alias(f"v{i}") for i in range(len(numbers))],
            *[(F.trim(t[f"n{i}"]) != "").alias(f"filled{i}") for i in range(len(amounts))],
        )

    def of(v: Callable[[str], Column]) -> tuple[Column, Column]:
        """Amount, and whether one of its columns is unreadable."""
        bad = reduce(lambda a, b: a | b, [v(f"filled{i}") & v(f"v{i}").isNull() for i in range(len(amounts))])
        return amount(*[v(f"v{i}") for i in range(len(amounts))]), bad

    def keep(v: Column) -> Column:
        figure, bad = of(lambda n: v[n])
        blank = (F.trim(v["date_text"]) == "") | (v["text"] == "") | (figure.isNull() & ~bad)
        return ~blank | F.col("names").isNull()

    figure, unreadable = of(F.col)
    more = {"original_amount": F.when(F.col(f"v{len(amounts)}") != 0, -F.col(f"v{len(amounts)}"))} if foreign else {}
    return C.valued(rows, texts, values, keep).select(
        *C.record(
            txn_date=F.col("parsed"),
            date_raw=F.col("date_text"),
            description=F.col("text"),
            amount=F.when(~unreadable, figure),
            source_type=source_type,
            source_rank=rank,
            reject=F.coalesce(
                F.when(F.col("names").isNull(), F.lit(C.NO_HEADER)),
                C.unreadable_date(F.col("date_text"), F.col("parsed")),
                F.when(unreadable, F.lit("unreadable amount")),
            ),
            raw=C.raw_map(),
            **more,
        )
    )


def parse_ing(rows: DataFrame, rank: int = 3) -> DataFrame:
    """Date, Description, Credit, Debit, Balance; a non-zero credit wins over a debit."""
    return _simple(C.with_header(rows, ING_HEADER), "Date", "Description", ("Credit", "Debit"), S.sign_split, "ing", rank)


def parse_bankwest(rows: DataFrame, rank: int = 7) -> DataFrame:
    """Nine columns; a non-zero debit wins over a credit."""
    data = C.with_header(rows, BANKWEST_HEADER)
    amount = partial(S.sign_split, credit_first=False)
    return _simple(data, "Transaction Date", "Narration", ("Credit", "Debit"), amount, "bankwest", rank)


def parse_amex(rows: DataFrame, rank: int = 8) -> DataFrame:
    """Purchases are positive in the export, so signs are flipped; the foreign currency has no code."""
    data = C.with_header(rows, AMEX_HEADER)
    return _simple(data, "Date", "Description", ("Amount",), lambda a: -a, "amex", rank, foreign="Foreign Spend Amount")


# fixed values: names the rental platform has used for each column, in order of preference
AIRBNB_ALIASES = {
    "date": ("date", "payout date", "payment date", "start date"),
    "type": ("type", "transaction type", "payout type"),
    "gross": ("gross earnings", "amount", "gross", "total"),
    "host_fee": ("host service fee", "host fee", "service fee"),
    "net": ("net payout", "net", "paid out", "payout"),
    "listing": ("listing", "listing name", "property"),
    "confirmation": ("confirmation code", "confirmation", "reservation code"),
    "guest": ("guest", "guest name"),
}
# fixed values: words that make a line look like its header
AIRBNB_WORDS = ("date", "type", "amount", "payout", "gross", "net", "listing", "confirmation", "earnings", "paid")
AIRBNB_HEADER_LINES = 20
AIRBNB_MIN_WORDS = 3


def _airbnb_header(rows: DataFrame) -> DataFrame:
    """Names and header position per file: the first of its first 20 rows with three known words, else its first row.

    A first row without the word 'date' cannot be a header that yields anything. Only the first rows of each file are looked at.
    """
    starts = C.starts(rows)
    top = C.per_file(rows, starts).where(
        (F.col("block") == F.col("_start.block")) & (F.col("seq") < F.col("_start.seq") + AIRBNB_HEADER_LINES)
    )
    line = F.struct(F.lower(F.array_join("cells", ",")).alias("line"))
    score = lambda t: F.struct(t["line"].alias("line"), sum((t["line"].contains(w).cast("int") for w in AIRBNB_WORDS), F.lit(0)).alias("score"))
    scored = C.valued(top.withColumn("at", C.position()), line, score)
    hit = F.col("score") >= AIRBNB_MIN_WORDS
    best = scored.where(hit | (F.col("line").contains("date") & (F.col("at") == F.col("_start")))).groupBy("file").agg(
        F.min_by("cells", F.struct((~hit).cast("int"), F.col("at"))).alias("names"),
        F.min(F.struct((~hit).cast("int").alias("k"), F.col("at").alias("s"))).alias("_at"),
    )
    found = best.select("file", C.trimmed(F.col("names")).alias("names"), F.col("_at.s").alias("_found_at"))
    every = starts.join(found, "file", "left")
    lowered = F.transform("names", lambda n: F.lower(n))
    named = C.labelled(every.select("file", "names", lowered.alias("_lowered"), F.coalesce("_found_at", "_start").alias("_header_at")))
    headless = ~F.coalesce(F.arrays_overlap("_lowered", F.array(*[F.lit(a) for a in AIRBNB_ALIASES["date"]])), F.lit(False))
    return named.withColumns({"_headless": headless, **{f"_at_{n}": _place(n) for n in AIRBNB_ALIASES}}).drop("_lowered")


def _place(canonical: str) -> Column:
    """Place of the first alias that the file has a column for."""
    found = [F.nullif(F.array_position("_lowered", a), F.lit(0)) for a in AIRBNB_ALIASES[canonical]]
    return (F.coalesce(*found) - 1).cast("int")


def parse_airbnb(rows: DataFrame, rank: int = 1) -> DataFrame:
    """Payouts: net if it is not zero, else gross; zero rows are dropped. A file without a date column is one rejected row."""
    data = C.per_file(rows, _airbnb_header(rows)).where(C.position() >= F.col("_header_at"))
    texts = F.struct(*[F.trim(F.coalesce(F.get("cells", F.col(f"_at_{n}")), F.lit(""))).alias(n) for n in AIRBNB_ALIASES])
    numbers = {"net": "net", "gross": "gross", "fee": "host_fee"}

    def values(t: Column) -> Column:
        parts = [F.nullif(t[n], F.lit("")) for n in ("type", "listing", "guest")]
        return F.struct(
            t["date"].alias("date_text"),
            S.parse_dmy2(t["date"]).alias("parsed"),
            *[S.parse_amount_strict(t[n]).alias(k) for k, n in numbers.items()],
            F.concat_ws(" - ", F.lit("Airbnb"), *parts).alias("text"),
            F.nullif(t["confirmation"], F.lit("")).alias("confirmation"),
        )

    def of(v: Callable[[str], Column]) -> tuple[Column, Column]:
        """Amount, and whether a number of the row is unreadable."""
        net, gross, fee = v("net"), v("gross"), v("fee")
        return F.when(net != 0, net).when(net.isNotNull(), gross), net.isNull() | gross.isNull() | fee.isNull()

    def keep(v: Column) -> Column:
        amount, bad = of(lambda n: v[n])
        listed = (C.position() > F.col("_header_at")) & (v["date_text"] != "")
        return F.when(F.col("_headless"), C.position() == F.col("_header_at")).otherwise(listed & (bad | (amount != 0)))

    amount, unreadable = of(F.col)
    return C.valued(data, texts, values, keep).select(
        *C.record(
            txn_date=F.col("parsed"),
            date_raw=F.col("date_text"),
            description=F.col("text"),
            amount=amount,
            source_type="airbnb",
            source_rank=rank,
            reject=F.coalesce(
                F.when(F.col("_headless"), F.lit(C.NO_HEADER)),
                C.unreadable_date(F.col("date_text"), F.col("parsed")),
                F.when(unreadable, F.lit("unreadable amount")),
            ),
            raw=C.raw_map(),
            fee=F.abs("fee"),
            reference_id=F.col("confirmation"),
        )
    )


# fixed values: row types of the payment provider
PAYPAL_CONVERSIONS = ("General Currency Conversion", "General currency conversion")
PAYPAL_SKIPPED = (*PAYPAL_CONVERSIONS, "Temporary Hold", "General Authorization")
PAYPAL_FIELDS = ("Description", "Type", "Status", "Transaction ID", "Reference Txn ID", "Name", "Currency", "Gross", "Fee", "Date")


def _paypal_amount(text: Column) -> Column:
    bare = F.trim(F.regexp_replace(text, "[, ]", ""))
    return F.when(bare == "", F.lit(0).cast(MONEY)).otherwise(bare.try_cast(MONEY))


def parse_paypal(rows: DataFrame, rank: int = 0) -> DataFrame:
    """Two layouts, told apart by their type column; conversion rows are merged into their payment."""
    data = C.with_header(rows, PAYPAL_HEADER, PAYPAL_FIELDS)
    kind = F.trim(F.coalesce(F.nullif(C.placed("Description"), F.lit("")), C.placed("Type")))
    prepared = data.select(
        "file",
        "block",
        "seq",
        C.position().alias("arrival"),
        kind.alias("kind"),
        F.trim(C.placed("Status")).alias("status"),
        F.trim(C.placed("Transaction ID")).alias("txn_ref"),
        F.trim(C.placed("Reference Txn ID")).alias("parent_ref"),
        F.trim(C.placed("Name")).alias("name"),
        F.trim(C.placed("Currency")).alias("currency"),
        _paypal_amount(C.placed("Gross")).alias("gross"),
        _paypal_amount(C.placed("Fee")).alias("fee"),
        F.trim(C.placed("Date")).alias("date"),
        C.raw_map().alias("raw"),
    )
    conversion = F.col("kind").isin(*PAYPAL_CONVERSIONS)
    keep = F.col("status").isin("", "Completed") & ~F.col("kind").isin(*PAYPAL_SKIPPED)
    merged = collapse_conversions(prepared, conversion, keep)
    parsed = S.parse_dmy("date")
    text = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("kind"), F.lit("")))
    unreadable = F.when(F.col("amount").isNull() | F.col("fee").isNull(), F.lit("unreadable amount"))
    headless = F.col("raw").isNull()
    return merged.where(((F.col("date") != "") & text.isNotNull()) | headless).select(
        *C.record(
            txn_date=parsed,
            date_raw=F.col("date"),
            description=text,
            amount=F.col("amount"),
            source_type="paypal",
            source_rank=rank,
            reject=F.coalesce(F.when(headless, F.lit(C.NO_HEADER)), C.unreadable_date(F.col("date"), parsed), unreadable),
            raw=F.col("raw"),
            currency=F.col("currency"),
            original_amount=F.col("original_amount"),
            original_currency=F.col("original_currency"),
            fee=F.abs("fee"),
            reference_id=F.col("txn_ref"),
        )
    )


def read_ing_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_ing(C.read_cells(spark, path))


def read_bankwest_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_bankwest(C.read_cells(spark, path))


def read_amex_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_amex(C.read_cells(spark, path))


def read_airbnb_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_airbnb(C.read_cells(spark, path))


def read_paypal_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_paypal(C.read_cells(spark, path))
