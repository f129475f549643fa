"""Statement lines stitched into transactions.

Input: one row per line of extracted statement text (``file``, ``block``, ``seq``, ``text``; ``block`` is a page or a
file block). What a line-by-line reader would keep as state is a small machine whose maps of chunks compose, together with
running sums and carried values, so a statement of any length is processed by many tasks and its lines are shuffled
once. Only lines of one entry are ever brought together, and at most ``PART_LINES`` of them in one row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators.lookup import hot_key_join
from tallyloom.operators.running import Machine, accumulate, filled
from tallyloom.schema import MONEY, REJECT
from tallyloom.sources.cells import record

POS = ("block", "seq")
HEAD, NOISE, FOOT, EXTRA, DATE, TEXT = "H", "N", "F", "X", "D", "T"
#: states of a statement: outside a section, in one without an entry, in an entry; and the lines that change them.
#: A footer closes a section only while an entry is open, and the next header opens it again.
OUTSIDE, SECTION, ENTRY = 0, 1, 2
EVENTS = {HEAD: (SECTION, SECTION, ENTRY), DATE: (OUTSIDE, ENTRY, ENTRY), FOOT: (OUTSIDE, SECTION, OUTSIDE)}
#: lines of an entry that are one transaction; more of them go to quarantine in parts of this size
PART_LINES = 10_000
TOO_LONG = "entry of too many lines"


@dataclass(frozen=True)
class Layout:
    """How the lines of one kind of statement are told apart."""

    source_type: str
    rank: int
    date: str
    header: Callable[[Column], Column] | None = None
    noise: Callable[[Column], Column] | None = None
    footer: Callable[[Column], Column] | None = None
    extra: Callable[[Column], Column] | None = None
    #: whether statement values may stand on the line after their label
    looks_ahead: bool = False
    #: lines from the top in which a bare year counts, and the year of statements that print none
    year_lines: int = 30
    default_year: str = "2025"


def _starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for p in prefixes:
        test = test | text.startswith(p)
    return test


def _contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for p in parts:
        test = test | text.contains(p)
    return test


# --- fixed values: what the lines of each bank's statement look like ---------------------------------------------------

ING_DATE = r"^(\d{2}/\d{2}/\d{4})\s+(.+)"
ING_HEADER = r"^Date\s+Details\s+(Money|Debit)"
ING_NOISE = (
    r"^(Page \d+ of \d+|Transactions(\s+\(continued\))?$|Transactions for \d+$|Opening balance|Closing balance"
    r"|\d+-[ISE]$|Statement continued)"
)
ING_FOOTERS = (
    "Total Cashback Financial Year",
    "Total Interest Financial Year",
    "Total Interest for this statement",
    "Interest rate at end of statement",
    "Total Fees Financial Year",
    "Total Rebates Financial Year",
    "Total Rounded Up",
    "Please check all transactions carefully",
    "We recommend you retain",
    "Keeping you safe and secure",
    "ING takes the security",
    "There were no transactions",
    "Important Reminder",
    "Always here to help",
    "ING is a business name",
    "ING, a business name",
    "Client 1, Tax File",
    "Client 2, Tax File",
    "Any advice in this statement",
)
BANKWEST_DATE = r"^(\d{2}\s+\w{3}\s+\d{2})\s+(.+)"
BANKWEST_HEADER = r"^Date\s+Description\s+(Debit|Amount)"
BANKWEST_NOISE = (
    r"^(Opening balance|Closing balance|Date\s+Description|Bankwest Zero|Account number|Your transactions|Summary"
    r"|Purchases\s+\$|Cash advances|Balance transfers|Interest and other|Payments and other|Transaction details"
    r"|Standard interest|These rates|\d+ of \d+$)"
)
BANKWEST_FOREIGN = r"^\d+[\.,]\d{2}\s+[A-Z]{3}$"
BANKWEST_CREDITS = ("PAYMENT RECEIVED", "CREDIT", "REFUND", "REVERSAL")
HSBC_DATE = r"^(\d{1,2}\s+\w{3}(?:\s+\d{2,4})?|\d{1,2}/\d{2}(?:/\d{2,4})?)\s+(.*)"
HSBC_NOISE = (
    "OPENING BALANCE",
    "CLOSING BALANCE",
    "BALANCE BROUGHT FORWARD",
    "BALANCE AUD",
    "BALANCE USD",
    "BALANCE EUR",
)
COLES_DATE = r"^(\d{1,2}\s+\w{3}(?:\s+\d{2,4})?|\d{1,2}/\d{2}(?:/\d{2,4})?|\w{3}\s+\d{1,2})\s+(.*)"
COLES_POST_DATE = r"^(\d{1,2}\s+\w{3}|\d{1,2}/\d{2}(?:/\d{2,4})?|\w{3}\s+\d{1,2})\s+"
COLES_NOISE = (
    "closing balance",
    "minimum payment",
    "opening balance",
    "statement summary",
    "credit limit",
    "payment due",
    "important information",
    "card number",
    "primary card",
    "page ",
    "customer support",
    "account number",
    "account name",
    "statement begins",
    "statement ends",
)
LONG_REFERENCE = r"(\d{10,})\s+(-?[\d,]+\.\d{2})\s*$"
NUMBER = r"-?[\d,]+\.\d{2}"
DOLLARS = r"\$[\d,]+\.\d{2}"
THREE = r"([\d,]+\.\d{2})\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2})\s*$"
TWO = r"([\d,]+\.\d{2})\s+([\d,]+\.\d{2})\s*$"
ONE = r"(-?[\d,]+\.\d{2})\s*$"

ING = Layout(
    "ing",
    2,
    ING_DATE,
    header=lambda t: t.rlike(ING_HEADER),
    noise=lambda t: t.rlike(ING_NOISE),
    footer=lambda t: _starts_with_any(t, ING_FOOTERS),
)
BANKWEST = Layout(
    "bankwest",
    6,
    BANKWEST_DATE,
    header=lambda t: t.rlike(BANKWEST_HEADER),
    noise=lambda t: t.rlike(BANKWEST_NOISE),
    extra=lambda t: t.rlike(BANKWEST_FOREIGN),
    looks_ahead=True,
)
HSBC = Layout("hsbc", 4, HSBC_DATE, noise=lambda t: S.once(F.upper(t), lambda u: _contains_any(u, HSBC_NOISE)), looks_ahead=True)
COLES = Layout(
    "coles",
    5,
    COLES_DATE,
    header=lambda t: S.once(F.lower(t), lambda l: l.contains("amount") & l.rlike("transaction|date|description")),
    noise=lambda t: S.once(F.lower(t), lambda l: _contains_any(l, COLES_NOISE)),
    looks_ahead=True,
)


# --- sections and entries ------------------------------------------------------------------------------------------------


def line_kind(layout: Layout) -> Column:
    """Header, noise, extra, date, footer or plain text; a footer only counts where no date starts the line."""

    def of(text: Column) -> Column:
        kind = F.when(layout.header(text), HEAD) if layout.header else F.when(F.lit(False), HEAD)
        if layout.noise:
            kind = kind.when(layout.noise(text), NOISE)
        if layout.extra:
            kind = kind.when(layout.extra(text), EXTRA)
        kind = kind.when(text.rlike(layout.date), DATE)
        if layout.footer:
            kind = kind.when(layout.footer(text), FOOT)
        return kind.otherwise(TEXT)

    return S.once(F.col("text"), of)


def mark_lines(lines: DataFrame, layout: Layout, until: Column | None = None) -> DataFrame:
    """Lines with their kind, number in the file, entry number, part of the entry, and the state of the statement after them.

    With ``until``, a condition on ``text``, ``rest`` and ``kind``, there is also ``stopped``: the place of the last line before, a date line or
    text in an entry, that met it, and ``dated``: the place of the entry's date line.
    """
    trimmed = lines.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    known = trimmed.withColumn("kind", F.when(F.col("text") != "", line_kind(layout)))
    kind, pos = F.col("kind"), F.struct(*POS)
    events = F.lit(None).cast("int")
    for number, name in enumerate(EVENTS):
        events = F.when(kind == name, number).otherwise(events)
    machine = Machine(tuple(EVENTS.values()), SECTION if layout.header is None else OUTSIDE)
    known = with_rest(known, layout) if until is not None else known
    marked = accumulate(
        known,
        sums={
            "line_no": F.lit(1),
            "entry": (kind == DATE).cast("long"),
        },
        lasts={"dated": F.when(kind == DATE, pos)} if until is not None else None,
        earlier={"stopped": F.when(kind.isin(DATE, TEXT) & until, pos)} if until is not None else None,
        marks={"_date_line": ("line_no", kind == DATE)},
        nexts={"next_text": filled("text")} if layout.looks_ahead else None,
        states={"state": (machine, events)},
    )
    part = F.floor((F.col("line_no") - F.col("_date_line")) / PART_LINES).cast("long")
    if not layout.looks_ahead:
        marked = marked.withColumn("next_text", F.lit(None).cast("string"))
    return marked.where(F.col("text") != "").withColumn("part", F.coalesce(part, F.lit(0).cast("long"))).drop("_date_line")


def in_section(marked: DataFrame) -> DataFrame:
    """Lines of transaction sections."""
    return marked.where((F.col("state") != OUTSIDE) & F.col("kind").isin(DATE, TEXT, EXTRA))


def in_entry(marked: DataFrame) -> DataFrame:
    """Lines that belong to an entry; what follows a section's header before its first date belongs to none."""
    return marked.where((F.col("state") == ENTRY) & F.col("kind").isin(DATE, TEXT, EXTRA))


def not_stopped(lines: DataFrame) -> DataFrame:
    """Lines of an entry up to the first one that met the condition of ``mark_lines``."""
    return lines.where(F.col("stopped").isNull() | (F.col("stopped") < F.col("dated")))


def entries(lines: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """One row per part of an entry with its lines in order; entries whose date line is not among ``lines`` are dropped.

    ``more`` names columns that were computed per line and are gathered with it. All parts but the first begin within the entry.
    """
    line = F.struct(*POS, "kind", "text", *more)
    grouped = lines.where(F.col("entry") > 0).groupBy("file", "entry", "part").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    first = F.col("lines")[0]
    return grouped.where((first["kind"] == DATE) | (F.col("part") > 0)).withColumns({"block": first["block"], "seq": first["seq"]})


def with_rest(lines: DataFrame, layout: Layout) -> DataFrame:
    """``rest``: the part of a line that may hold text and amounts, on a date line what follows the date."""
    after = F.when(F.col("kind") == DATE, F.trim(F.regexp_extract("text", layout.date, 2)))
    return lines.withColumn("rest", F.coalesce(after, F.col("text")))


def ended(found: DataFrame, until: Column) -> DataFrame:
    """Entries whose last line meets the condition; the others have no amount within their first ``PART_LINES`` lines."""
    last = found.where("part = 0").withColumn("rest", F.element_at("lines", -1)["rest"])
    return last.where(until).drop("rest")


def with_parts(found: DataFrame, layout: Layout) -> DataFrame:
    """``date_text`` of the date line and the ``parts`` of the entry, line by line."""
    return found.withColumns(
        {
            "date_text": F.regexp_extract(F.col("lines")[0]["text"], layout.date, 1),
            "parts": F.transform("lines", lambda e: e["rest"]),
        }
    )


def evaluated(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row, whatever is made of them.

    A filter on plain columns is moved below them, with all that they are made of in place of each mention.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _joined(parts: Column) -> Column:
    return S.collapse_ws(F.array_join(F.filter(parts, lambda p: p != ""), " "))


def _number(text: Column) -> Column:
    return F.regexp_replace(text, r"[,$\s]", "").try_cast(MONEY)


# --- statement attributes ------------------------------------------------------------------------------------------------


def _first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First capture of the file, by line."""
    found = F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    return F.min_by(found, F.when(found.isNotNull(), F.struct(*POS)))


def _two_lines() -> Column:
    """A line with the next one, for values printed below their label."""
    return F.concat_ws("\n", "text", "next_text")


def closing_balance_of(pattern: str = r"Closing Balance\s+\$?([\d,]+\.\d{2})") -> Column:
    return _first_match(_two_lines(), pattern)


def _early_year(layout: Layout, skip: Column | None = None) -> Column:
    early = F.col("line_no") <= layout.year_lines
    usable = early if skip is None else early & ~skip
    return _first_match(F.when(usable, F.col("text")).otherwise(""), r"\b(20\d{2})\b")


#: fixed values: how a statement prints its period
HSBC_PERIOD = r"(\d{1,2}\s+(\w{3})\s+(\d{4}))\s+to\s+\d{1,2}\s+\w{3}\s+\d{4}"
COLES_PERIOD = r"Statement Period\s+\d{1,2}/\d{2}/(\d{2})\s+-\s+\d{1,2}/(\d{2})/(\d{2})"
PRINTED_YEAR = r"^(\d{1,2}\s+\w{3}\s+\d{2,4}|\d{1,2}/\d{2}/\d{2,4})$"


def near_period(parsed: Column, start_month: Column | None = None, end_month: Column | None = None) -> Column:
    """Dates without a printed year moved into the period of a statement that spans New Year.

    A month before the start month belongs to the following year, one after the end month to the year before.
    """
    free = ~F.col("date_text").rlike(PRINTED_YEAR)
    if start_month is not None:
        return F.when(free & (F.month(parsed) < start_month), F.add_months(parsed, 12)).otherwise(parsed)
    return F.when(free & (F.month(parsed) > end_month), F.add_months(parsed, -12)).otherwise(parsed)


def _dated(facts: DataFrame, layout: Layout) -> DataFrame:
    """The default year where a statement prints none; ``year_assumed`` tells."""
    return facts.withColumns({"year": F.coalesce("year", F.lit(layout.default_year)), "year_assumed": F.col("year").isNull()})


def hsbc_attributes(marked: DataFrame, layout: Layout = HSBC) -> DataFrame:
    """Per file: year and month of the period's start, closing balance, whether there is a balance column."""
    lower = F.lower("text")
    facts = marked.groupBy("file").agg(
        F.coalesce(_first_match(_two_lines(), HSBC_PERIOD, 3), _early_year(layout)).alias("year"),
        F.month(
            F.try_to_date(F.concat(F.lit("1 "), _first_match(_two_lines(), HSBC_PERIOD, 2), F.lit(" 2000")), "d MMM yyyy")
        ).alias("start_month"),
        closing_balance_of().alias("closing_balance"),
        (F.max(lower.contains("balance")) & F.max(lower.contains("debit") | lower.contains("credit"))).alias("has_balance"),
    )
    return _dated(facts, layout)


#: fixed values: month names as printed
MONTH_NAMES = "January|February|March|April|May|June|July|August|September|October|November|December"


def coles_attributes(marked: DataFrame, layout: Layout = COLES) -> DataFrame:
    """Per file: year and month of the period's end, closing balance."""
    short = _first_match(_two_lines(), COLES_PERIOD, 3)
    facts = marked.groupBy("file").agg(
        F.coalesce(
            F.concat(F.lit("20"), short),
            _first_match(_two_lines(), r"(?i)Statement\s+(?:Ends|Period)[:\s]+.*?(\d{4})"),
            _first_match(_two_lines(), rf"(?:{MONTH_NAMES})\s+(20\d{{2}})"),
            _early_year(layout, F.col("text").rlike(r"\d{4}\s+\d{4}\s+\d{4}")),
        ).alias("year"),
        _first_match(_two_lines(), COLES_PERIOD, 2).cast("int").alias("end_month"),
        closing_balance_of().alias("closing_balance"),
    )
    return _dated(facts, layout)


# --- amounts -------------------------------------------------------------------------------------------------------------


def with_ing_columns(lines: DataFrame, text: str, name: str = "cols") -> DataFrame:
    """Add struct(found, rest, money_out, money_in, balance, amount) from the last two or three numbers of a line.

    The last number is the balance. A third one from the end belongs to the columns if fewer than 15 characters
    separate it from the next; of two, a negative first is money out. Each line is scanned twice and not once per use.
    """
    scanned = F.struct(
        F.col(text).alias("text"),
        F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1).alias("numbers"),
        F.split(text, NUMBER).alias("gaps"),
    )
    return lines.withColumn(name, S.once(scanned, lambda line: S.once(_ing_places(line), _ing_columns)))


def _ing_places(line: Column) -> Column:
    n = F.size(line["numbers"])

    def number(back: int) -> Column:
        return F.get(line["numbers"], n - back)

    def gap(back: int) -> Column:
        return F.coalesce(F.length(F.get(line["gaps"], n - back)), F.lit(0))

    three = (n >= 3) & (gap(2) < 15)
    start = F.length(line["text"]) - gap(0) - F.length(number(1)) - gap(1) - F.length(number(2))
    start = F.when(three, start - gap(2) - F.length(number(3))).otherwise(start)
    negative = number(2).startswith("-")
    found = n >= 2
    return F.struct(
        F.when(found, F.trim(F.substring(line["text"], F.lit(1), start))).alias("left"),
        F.when(found, F.when(three, number(3)).when(negative, number(2))).alias("out"),
        F.when(found, F.when(three | ~negative, number(2))).alias("into"),
        F.when(found, number(1)).alias("balance"),
    )


def _ing_columns(place: Column) -> Column:
    return F.struct(
        place["left"].isNotNull().alias("found"),
        place["left"].alias("rest"),
        place["out"].alias("money_out"),
        place["into"].alias("money_in"),
        place["balance"].alias("balance"),
        S.sign_split(_number(place["into"]), _number(place["out"]), credit_first=False).alias("amount"),
    )


def stitch_ing(lines: DataFrame, layout: Layout = ING) -> DataFrame:
    """Everything up to the next date or footer belongs to an entry; the first line with a non-zero amount gives it."""
    members = with_ing_columns(with_rest(in_entry(mark_lines(lines, layout)), layout), "rest")
    gathered = entries(members, more=("rest", "cols"))
    found = with_parts(gathered, layout)
    at = F.array_position(F.transform("lines", lambda e: e["cols"]["amount"].isNotNull()), True)
    found = found.withColumn("_at", at).where((F.col("_at") > 0) | (F.col("part") > 0))
    found = found.withColumn("_hit", F.get("lines", (F.col("_at") - 1).cast("int"))["cols"])

    def text_of(e: Column, i: Column) -> Column:
        return F.when((i < F.col("_at")) & e["cols"]["found"], e["cols"]["rest"]).otherwise(e["rest"])

    found = evaluated(found, _parsed=S.parse_dmy("date_text"), _description=_joined(F.transform("lines", text_of)))
    parsed, description = F.col("_parsed"), F.col("_description")
    raw = F.create_map(
        F.lit("date"), F.col("date_text"),
        F.lit("description"), description,
        F.lit("money_out"), F.coalesce("_hit.money_out", F.lit("")),
        F.lit("money_in"), F.coalesce("_hit.money_in", F.lit("")),
        F.lit("balance"), F.col("_hit.balance"),
    )
    return _records(found, layout, parsed, description, F.col("_hit.amount"), raw)


def stitch_bankwest(lines: DataFrame, layout: Layout = BANKWEST) -> DataFrame:
    """All later lines belong to an entry, foreign amounts in brackets; payments and refunds are credits."""
    marked = mark_lines(lines, layout)
    balances = marked.groupBy("file").agg(
        closing_balance_of(r"Closing [Bb]alance\s+\$?([\d,]+\.\d{2})").alias("closing_balance")
    )
    foreign = F.col("kind") == EXTRA
    members = with_rest(in_entry(marked), layout).withColumns(
        {
            "amounts": F.when(foreign, F.array().cast("array<string>")).otherwise(
                F.regexp_extract_all("rest", F.lit(f"({DOLLARS})"), 1)
            ),
            "bare": F.trim(F.regexp_replace("rest", DOLLARS, "")),
        }
    )
    members = members.withColumn("rest", F.when(foreign, F.concat(F.lit("("), "rest", F.lit(")"))).otherwise(F.col("rest")))
    gathered = entries(members, more=("rest", "amounts", "bare"))
    found = with_parts(gathered, layout)
    at = F.array_position(F.transform("lines", lambda e: F.size(e["amounts"]) > 0), True)
    found = found.withColumn("_at", at).where((F.col("_at") > 0) | (F.col("part") > 0))
    texts = F.transform("lines", lambda e, i: F.when(i == F.col("_at") - 1, e["bare"]).otherwise(e["rest"]))
    hit = F.get("lines", (F.col("_at") - 1).cast("int"))["amounts"]
    found = evaluated(found, _texts=texts, _hit=hit)
    so_far = F.upper(F.array_join(F.slice("_texts", F.lit(1), F.col("_at").cast("int")), " "))
    first, second = _number(F.get("_hit", F.lit(0))), _number(F.get("_hit", F.lit(1)))
    on_date_line = F.col("_at") == 1
    amount = (
        F.when(on_date_line & (F.size("_hit") == 2), second - first)
        .when(on_date_line & (F.size("_hit") > 2), -first)
        .when(_contains_any(so_far, BANKWEST_CREDITS), first)
        .otherwise(-first)
    )
    parsed = S.parse_statement_date("date_text", F.lit(None).cast("string"))
    found = evaluated(found, _parsed=parsed, _description=_joined(F.col("_texts")), _amount=amount)
    found = hot_key_join(found, balances, ["file"])
    parsed, description, amount = F.col("_parsed"), F.col("_description"), F.col("_amount")
    return _records(found, layout, parsed, description, amount, _card_raw(parsed, description, amount))


def _card_raw(parsed: Column, description: Column, amount: Column, *more: Column) -> Column:
    return F.create_map(
        F.lit("date"), F.date_format(parsed, "yyyy-MM-dd"),
        F.lit("description"), description,
        F.lit("amount"), amount.cast("string"),
        F.lit("closing_balance"), F.coalesce(F.regexp_replace("closing_balance", ",", ""), F.lit("")),
        *more,
    )


def _year_marked(raw: Column) -> Column:
    """The raw audit says so where the year of a date is an assumption."""
    assumed = F.col("year_assumed") & ~F.col("date_text").rlike(PRINTED_YEAR)
    return F.when(assumed, F.map_concat(raw, F.create_map(F.lit("year"), F.lit("assumed")))).otherwise(raw)


def hsbc_amount(text: Column, has_balance: Column) -> Column:
    """struct(amount, balance, rest): debit, credit and balance; amount and balance, or debit and credit; or one signed amount."""

    def of(line: Column) -> Column:
        text, three, two, one = (line[n] for n in ("text", "three", "two", "one"))

        def group(pattern: str, i: int) -> Column:
            return _number(F.regexp_extract(text, pattern, i))

        two_balance = two & line["has_balance"]
        a2, b3 = group(TWO, 1), group(THREE, 2)
        amount = (
            F.when(three, F.when(b3 > 0, b3).otherwise(-group(THREE, 1)))
            .when(two_balance, -a2)
            .when(two, F.when(a2 > 0, -a2).otherwise(group(TWO, 2)))
            .when(one, -group(ONE, 1))
        )
        balance = F.when(three, group(THREE, 3)).when(two_balance, group(TWO, 2))
        rest = (
            F.when(three, F.regexp_replace(text, THREE, ""))
            .when(two, F.regexp_replace(text, TWO, ""))
            .when(one, F.regexp_replace(text, ONE, ""))
            .otherwise(text)
        )
        return F.struct(amount.alias("amount"), balance.alias("balance"), F.trim(rest).alias("rest"))

    kinds = {"three": text.rlike(THREE), "two": text.rlike(TWO), "one": text.rlike(ONE), "has_balance": has_balance}
    return S.once(F.struct(text.alias("text"), *[c.alias(n) for n, c in kinds.items()]), of)


def stitch_hsbc(lines: DataFrame, layout: Layout = HSBC, *, infer_year: bool = False) -> DataFrame:
    """An entry ends with its first line that has an amount.

    All dates without a year get the year of the period's start, or with ``infer_year`` the one that fits the period.
    """
    ends = F.col("rest").rlike(ONE)
    marked = mark_lines(lines, layout, ends)
    found = with_parts(ended(entries(not_stopped(in_entry(marked)), more=("rest",)), ends), layout)
    found = hot_key_join(found, hsbc_attributes(marked, layout), ["file"])
    parsed = S.parse_statement_date("date_text", F.col("year"))
    found = evaluated(found, _hit=hsbc_amount(F.element_at("parts", -1), F.col("has_balance")), _parsed=parsed)
    before = F.slice("parts", F.lit(1), F.size("parts") - 1)
    found = evaluated(found, _description=_joined(F.concat(before, F.array(F.col("_hit.rest")))))
    parsed = near_period(F.col("_parsed"), start_month=F.col("start_month")) if infer_year else F.col("_parsed")
    description, amount = F.col("_description"), F.col("_hit.amount")
    raw = _card_raw(parsed, description, amount, F.lit("balance"), F.coalesce(F.col("_hit.balance").cast("string"), F.lit("None")))
    return _records(found, layout, parsed, description, amount, _year_marked(raw))


def coles_amount(text: Column) -> Column:
    """struct(amount >= 0, is_credit, rest): sign or CR suffix, else an amount after a long reference."""

    def of(line: Column) -> Column:
        text, token, old = (line[n] for n in ("text", "token", "old"))
        by_reference = F.struct(
            F.abs(old).alias("amount"),
            (old < 0).alias("is_credit"),
            F.trim(F.regexp_replace(text, LONG_REFERENCE, "")).alias("rest"),
        )
        return F.when(token["amount"].isNotNull() | old.isNull(), token).otherwise(by_reference)

    def scanned(text: Column) -> Column:
        old = _number(F.regexp_extract(text, LONG_REFERENCE, 2))
        return F.struct(text.alias("text"), S.parse_money_token(text).alias("token"), old.alias("old"))

    return S.once(text, lambda t: S.once(scanned(t), of))


def strip_post_date(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, COLES_POST_DATE, ""))


def stitch_coles(lines: DataFrame, layout: Layout = COLES, *, infer_year: bool = False) -> DataFrame:
    """Purchases are money out, credits money in; the posting date after the transaction date is dropped.

    All dates without a year get the year of the period's end, or with ``infer_year`` the one that fits the period.
    """
    ends = F.col("rest").rlike(S.MONEY_TOKEN) | F.col("rest").rlike(LONG_REFERENCE)
    marked = mark_lines(lines, layout, ends)
    found = with_parts(ended(entries(not_stopped(in_entry(marked)), more=("rest",)), ends), layout)
    found = hot_key_join(found, coles_attributes(marked, layout), ["file"])
    parts = F.transform("parts", lambda p, i: F.when(i == 0, strip_post_date(p)).otherwise(p))
    found = evaluated(found, _parts=parts, _parsed=S.parse_statement_date("date_text", F.col("year")))
    found = evaluated(found, _hit=coles_amount(F.element_at("_parts", -1)))
    before = F.slice("_parts", F.lit(1), F.size("_parts") - 1)
    found = evaluated(found, _description=_joined(F.concat(before, F.array(F.col("_hit.rest")))))
    description = F.col("_description")
    amount = F.when(F.col("_hit.is_credit"), F.col("_hit.amount")).otherwise(-F.col("_hit.amount"))
    parsed = near_period(F.col("_parsed"), end_month=F.col("end_month")) if infer_year else F.col("_parsed")
    credit = F.when(F.col("_hit.is_credit"), "True").otherwise("False")
    raw = _card_raw(parsed, description, F.col("_hit.amount"), F.lit("is_credit"), credit)
    return _records(found, layout, parsed, description, amount, _year_marked(raw))


def _records(
    found: DataFrame, layout: Layout, parsed: Column, description: Column, amount: Column, raw: Column
) -> DataFrame:
    """Records of entries; the further parts of entries of very many lines go to quarantine, each with its own text."""
    further = F.col("part") > 0
    text = F.array_join("lines.text", "\n")
    out = found.select(
        *record(
            txn_date=F.when(~further, parsed),
            date_raw=F.when(further, F.lit("")).otherwise(F.col("date_text")),
            description=F.when(further, F.substring(text, 1, 200)).otherwise(description),
            amount=F.when(~further, amount),
            source_type=layout.source_type,
            source_rank=layout.rank,
            reject=F.when(further, F.lit(TOO_LONG)).when(parsed.isNull(), F.lit("unreadable date")),
            raw=F.when(further, F.create_map(F.lit("part"), F.col("part").cast("string"), F.lit("text"), text)).otherwise(raw),
        )
    )
    read = (F.col("description") != "") & F.col("amount").isNotNull()
    return out.where(read | (F.coalesce(REJECT, F.lit("")) == TOO_LONG))


STITCHERS = {"ing": stitch_ing, "bankwest": stitch_bankwest, "hsbc": stitch_hsbc, "coles": stitch_coles}
