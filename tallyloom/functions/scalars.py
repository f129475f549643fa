"""Column functions: dates, amounts, text, keys. Built-in expressions only."""

from __future__ import annotations

import datetime as dt

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.schema import HOME_CURRENCY, MONEY, RATE


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- dates ---------------------------------------------------------------------------------------------------------


def parse_dmy(text: Column | str) -> Column:
    """``D/M/YYYY``; impossible dates give NULL."""
    return F.try_to_date(F.trim(_c(text)), "d/M/yyyy")


def parse_dmy2(text: Column | str) -> Column:
    """``D/M/YYYY``, ``D/M/YY`` (20YY) or ISO."""
    t = F.trim(_c(text))
    return F.coalesce(F.try_to_date(t, "d/M/yyyy"), F.try_to_date(t, "d/M/yy"), F.try_to_date(t, "yyyy-MM-dd"))


def parse_statement_date(text: Column | str, year: Column | int) -> Column:
    """Statement dates: ``DD Mon [YY[YY]]``, ``Mon DD``, ``DD/MM[/YY[YY]]``; ``year`` fills in where none is printed.

    Month names are the English three-letter ones in title case.
    """
    y = F.lit(year).cast("string") if isinstance(year, int) else year.cast("string")

    def with_name(t: Column) -> Column:
        return F.struct(t.alias("text"), F.when(t.rlike(r"(^|\s)[A-Z][a-z]{2}(\s|$)"), t).alias("named"))

    def of(s: Column) -> Column:
        t, named = s["text"], s["named"]
        return F.coalesce(
            F.try_to_date(named, "d MMM yyyy"),
            F.try_to_date(named, "d MMM yy"),
            F.try_to_date(F.concat_ws(" ", F.when(named.rlike(r"^\d{1,2} \w{3}$"), named), y), "d MMM yyyy"),
            F.try_to_date(F.concat_ws(" ", F.when(named.rlike(r"^\w{3} \d{1,2}$"), named), y), "MMM d yyyy"),
            F.try_to_date(t, "d/M/yyyy"),
            F.try_to_date(t, "d/M/yy"),
            F.try_to_date(F.concat_ws("/", F.when(t.rlike(r"^\d{1,2}/\d{2}$"), t), y), "d/M/yyyy"),
        )

    return once(F.regexp_replace(F.trim(_c(text)), r"\s+", " "), lambda t: once(with_name(t), of))


def fy_of(date: Column | str) -> Column:
    """Financial year N runs from 1 July N-1 to 30 June N."""
    return F.year(F.add_months(_c(date), 6))


def fy_start(fy: int) -> dt.date:
    return dt.date(fy - 1, 7, 1)


def fy_end(fy: int) -> dt.date:
    return dt.date(fy, 6, 30)


def fy_bounds(fy: Column | str) -> tuple[Column, Column]:
    return F.make_date(_c(fy) - 1, F.lit(7), F.lit(1)), F.make_date(_c(fy), F.lit(6), F.lit(30))


def fy_label(fy: Column | str) -> Column:
    """``FY 2024-25``"""
    n = _c(fy)
    return F.concat(F.lit("FY "), (n - 1).cast("string"), F.lit("-"), F.substring(n.cast("string"), 3, 10))


def default_fy(today: Column | str) -> Column:
    """The last completed financial year."""
    return F.year(F.add_months(_c(today), 6)) - 1


def default_fy_on(today: dt.date) -> int:
    return today.year if today.month >= 7 else today.year - 1


def month_key(date: Column | str) -> Column:
    return F.date_format(_c(date), "yyyy-MM")


def year_key(date: Column | str) -> Column:
    return F.date_format(_c(date), "yyyy")


# --- amounts -------------------------------------------------------------------------------------------------------


def parse_amount_lenient(text: Column | str) -> Column:
    """Strip ``,`` and ``$``; blank or unreadable gives NULL."""
    return F.regexp_replace(F.trim(_c(text)), r"[,$]", "").try_cast(MONEY)


def parse_amount_strict(text: Column | str) -> Column:
    """Blank is zero; unreadable gives NULL, which the readers send to quarantine."""
    bare = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[,$ ]", "")
    return F.when(F.trim(bare) == "", F.lit(0).cast(MONEY)).otherwise(F.trim(bare).try_cast(MONEY))


#: fixed value: amount at the end of a line, with optional sign, dollar and CR/DR suffix
MONEY_TOKEN = r"(?i)(-?\$?[\d,]+\.\d{2})\s*(CR|DR)?\s*$"


def parse_money_token(text: Column | str) -> Column:
    """struct(amount >= 0, is_credit, rest): a CR suffix or a minus sign marks a credit; NULL amount when none is there."""

    def scanned(t: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(t, MONEY_TOKEN, 1), r"[,$]", "").try_cast(MONEY)
        return F.struct(t.alias("text"), number.alias("number"))

    def of(line: Column) -> Column:
        t, number = line["text"], line["number"]
        credit = (F.upper(F.regexp_extract(t, MONEY_TOKEN, 2)) == "CR") | F.coalesce(number < 0, F.lit(False))
        rest = F.when(number.isNull(), t).otherwise(F.trim(F.regexp_replace(t, MONEY_TOKEN, "")))
        return F.struct(F.abs(number).alias("amount"), credit.alias("is_credit"), rest.alias("rest"))

    return once(_c(text), lambda t: once(scanned(t), of))


def sign_split(credit: Column, debit: Column, credit_first: bool = True) -> Column:
    """Signed amount of a credit/debit column pair; the first non-zero one of the given order counts."""
    into = F.when(credit != 0, credit)
    out = F.when(debit != 0, -F.abs(debit))
    return F.coalesce(into, out) if credit_first else F.coalesce(out, into)


def fx_rate(amount: Column | str, original_amount: Column | str, original_currency: Column | str) -> Column:
    """Home currency per unit of the original currency, 6 decimals; NULL for home currency or zero amounts."""
    a, o, cur = _c(amount), _c(original_amount), _c(original_currency)
    usable = (cur != HOME_CURRENCY) & (cur != "") & (a != 0) & (o != 0)
    return F.when(usable, F.round(F.abs(a).cast("decimal(18,2)") / F.abs(o).cast("decimal(18,2)"), 6).cast(RATE))


def unconverted_fx(amount: Column | str, original_amount: Column | str, original_currency: Column | str) -> Column:
    """A foreign amount stored as it is, because no conversion was found."""
    a, o, cur = _c(amount), _c(original_amount), _c(original_currency)
    flag = cur.isNotNull() & (cur != "") & o.isNotNull() & (o != 0) & (F.abs(a) == F.abs(o))
    return F.coalesce(flag, F.lit(False))


# --- text and keys -------------------------------------------------------------------------------------------------


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once per row, however often ``f`` names it.

    A filter that is moved below a projection repeats the definition of a column at each mention. Also keeps long expressions
    out of the generated method of a stage, which the JVM leaves uncompiled above 8 000 bytes.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def collapse_ws(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def upper_contains(text: Column | str, needle: str) -> Column:
    return F.upper(_c(text)).contains(needle.upper())


def merchant_key(description: Column | str) -> Column:
    return F.upper(F.substring(_c(description), 1, 40))


def file_stem(path: Column | str) -> Column:
    return F.regexp_extract(file_base(path), r"([^/]+?)(\.[^./]+)?$", 1)


def file_base(path: Column | str) -> Column:
    """What follows the last slash. A pattern that looks for it from each place of a path takes ten times as long."""
    return F.substring_index(_c(path), "/", -1)


#: fixed value: prefix of references that come from the open-banking aggregator
AGGREGATOR_PREFIX = "basiq:"


def keyed_by_reference(source_type: Column | str = "source_type", reference_id: Column | str = "reference_id") -> Column:
    """Whether a record is identified by its provider reference instead of by its content."""
    ref = _c(reference_id)
    paypal = (_c(source_type) == "paypal") & (ref != "")
    return F.coalesce(ref.startswith(AGGREGATOR_PREFIX) | paypal, F.lit(False))


def dedup_hash(
    txn_date: Column | str = "txn_date",
    description: Column | str = "description",
    amount: Column | str = "amount",
    source_type: Column | str = "source_type",
    source_file: Column | str = "source_file",
    reference_id: Column | str = "reference_id",
) -> Column:
    """SHA-256 identity of a record.

    Provider reference where there is one to trust, else date, text and amount; one bank also needs the file stem, so
    that equal transfers between two of its accounts stay apart. The amount is written with the fewest decimals >= 1.
    """
    day = F.date_format(_c(txn_date), "yyyy-MM-dd")
    money = F.regexp_replace(_c(amount).cast(MONEY).cast("string"), "0$", "")
    stem = F.coalesce(file_stem(source_file), F.lit(""))
    content = F.concat_ws("|", day, _c(description), money)
    return F.sha2(
        F.when(keyed_by_reference(source_type, reference_id), _c(reference_id))
        .when(_c(source_type) == "ing", F.concat_ws("|", content, stem))
        .otherwise(content),
        256,
    )


#: fixed value: where a statement's running balance may be found, in order of preference
BALANCE_KEYS = ("closing_balance", "Balance", "balance")


def recorded_balance(raw: Column | str, account_type: Column | str) -> Column:
    """Balance printed on a record, NULL when it has none or one that cannot be read.

    A zero under the first two keys falls through to the next one, a zero under the last is a balance. Positive
    balances of credit and loan accounts are debts.
    """
    r = _c(raw)
    picked = None
    for key in BALANCE_KEYS:
        text = r[key]
        usable = text.isNotNull() & ~text.isin("", "None")
        number = F.regexp_replace(F.trim(text), ",", "").try_cast(MONEY)
        take = usable if key == BALANCE_KEYS[-1] else usable & (number.isNull() | (number != 0))
        picked = F.when(take, number) if picked is None else picked.when(take, number)
    debt = _c(account_type).isin("credit", "loan") & (picked > 0)
    return F.when(debt, -picked).otherwise(picked)
