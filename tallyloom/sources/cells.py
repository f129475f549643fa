"""CSV files read by header name.

Rows become positional cells: those without quotes are split at their commas, the others go through Spark's own CSV parser. The
header row of each file is found among its rows. Files of
one folder may therefore have different column orders or layouts. A field is then ``cell at the position of its name``,
an expression without a join per column.

All files are split over tasks. A quoted cell may hold line ends, so whether a line begins inside quotes depends on all lines
before it: each line maps the state before it to the state after it, the maps of a chunk of lines compose to one, those
of the chunks of a file are composed in order, and then every line of every chunk knows its state. A pass over the lines tells
which files have a cell that goes on after its line; only their lines are shuffled, once, by chunk.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import scalars as S
from tallyloom.operators.lookup import CONFIG_ROWS, hot_key_join
from tallyloom.operators.running import accumulate, chunk
from tallyloom.schema import MONEY, REJECT

#: cells that the CSV reader itself fills; wider rows are split from their text, so no width is lost
WIDTH = 24
ROW_TEXT = "_row_text"
CELLS = T.StructType([*[T.StructField(f"c{i}", T.StringType()) for i in range(WIDTH)], T.StructField(ROW_TEXT, T.StringType())])
#: a cell with the comma before it
CELL = r',("[^"]*+(?:""[^"]*+)*+"(?=,|\z)|[^,]*)'
#: a quoted cell up to its closing quote, any whole cell with the comma after it, and a line that leaves a quoted cell open:
#: one that begins outside quotes, and one that begins inside
QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
WHOLE = rf'(?:{QUOTED}"[^,]*+|[^",][^,]*+|),'
OPENS = rf"^(?:{WHOLE})*+{QUOTED}\z"
STAYS = rf'^[^"]*+(?:""[^"]*+)*+(?:\z|"[^,]*+,(?:{WHOLE})*+{QUOTED}\z)'
#: a line that isn't blank
FILLED = r"[^\x00-\x20]"
#: lines of one row at most; a quote that stays open for longer is not the start of a cell of many lines
ROW_LINES = 10_000


PARSER = {
    "escape": '"',
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": ROW_TEXT,
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def files(reader, glob: str | None = None):
    """A reader of all files below a path, or of those that match."""
    reader = reader.option("recursiveFileLookup", True)
    return reader.option("pathGlobFilter", glob) if glob else reader


def split_row(text: Column) -> Column:
    """Cells of one CSV row of any width: quotes taken off, doubled ones made single."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(CELL), F.lit(1))
    quoted = r'(?s)^"(.*)"$'
    return F.transform(raw, lambda c: F.when(c.rlike(quoted), F.replace(F.regexp_extract(c, quoted, 1), F.lit('""'), F.lit('"'))).otherwise(c))


def _cells(text: Column) -> Column:
    """Cells of a row: split at its commas where it has no quotes, else by the parser.

    The parser throws for each cell that a row has less than its schema, so the row is filled up by the commas it lacks outside quotes.
    A row with as many commas as the parser has cells may be wider, whatever is in its cells; it is split from its text.
    """

    def commas(c: Column) -> Column:
        return F.length(c) - F.length(F.replace(c, F.lit(","), F.lit("")))

    def filled_up(bare: Column) -> Column:
        # not behind an open quote, nor behind blanks that may follow a closed one
        closed = ~bare.contains('"') & ~text.endswith(" ") & ~text.endswith("\t")
        return F.when(closed, F.concat(text, F.repeat(F.lit(","), WIDTH - 1 - commas(bare)))).otherwise(text)

    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in PARSER.items()}
    whole = S.once(F.regexp_replace(text, r'"[^"]*+"', ""), filled_up)
    fields = F.from_csv(whole, ", ".join(f"{f.name} string" for f in CELLS), options)
    parsed = S.once(fields, lambda f: F.array(*[f[f"c{i}"] for i in range(WIDTH)]))
    split = F.when(~text.contains('"'), F.split(text, ",")).when(commas(text) >= WIDTH, split_row(F.regexp_replace(text, r"[\r\n]+$", "")))
    return split.otherwise(parsed)


def _rows(lines: DataFrame) -> DataFrame:
    """file, block, seq, cells of lines with their text, without blank ones.

    Numbers of rows and cells are made together: a filter is not moved below numbers, where it would repeat the split.
    """
    filled = lines.where(F.col("text").rlike(FILLED))
    return filled.select("file", "block", F.monotonically_increasing_id().alias("seq"), _cells(F.col("text")).alias("cells"))


def _text(text: DataFrame) -> DataFrame:
    """file, block, text of the lines of a text frame, without a mark of their encoding."""
    block = F.col("_metadata.file_block_start")
    bare = F.when(block == 0, F.regexp_replace("value", r"^\ufeff", "")).otherwise(F.col("value"))
    return text.select(F.col("_metadata.file_path").alias("file"), block.alias("block"), F.make_valid_utf8(bare).alias("text"))


def open_quotes(lines: DataFrame) -> list[str]:
    """Files of a text frame in which a line that begins outside quotes may end inside. Names are those of ``DataFrame.inputFiles``."""
    return [r["file"] for r in lines.where(F.col("value").contains('"') & F.col("value").rlike(OPENS)).select(F.input_file_name().alias("file")).distinct().toLocalIterator()]


def inside_quotes(lines: DataFrame) -> DataFrame:
    """Lines (file, block, seq, text) with ``inside``: whether they begin inside quotes, and ``inside_after``.

    A line sets the state, turns it or leaves it: the state is what was last set, turned as often as lines turned it since. The same holds
    for chunks of lines, so a window within each chunk and one over the chunks of a file tell it. Lines are shuffled once.
    """
    outside, stays = F.col("text").rlike(OPENS), F.col("text").rlike(STAYS)
    key = ["file", "block", "_chunk"]
    known = lines.withColumns(
        {"_chunk": chunk(), "_set": F.when(outside == stays, outside.cast("long")), "_turn": (outside & ~stays).cast("long")}
    )
    within = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    local = known.withColumn("_turns", F.sum("_turn").over(within))
    mark = F.when(F.col("_set").isNotNull(), F.struct(F.col("_set").alias("v"), F.col("_turns").alias("at")))
    local = local.withColumn("_mark", F.last(mark, ignorenulls=True).over(within))

    totals = local.groupBy(*key).agg(F.sum("_turn").alias("t"), F.max_by("_mark", "seq").alias("m"))
    along = Window.partitionBy("file").orderBy("block", "_chunk")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    counted = totals.withColumn("_all", F.sum("t").over(so_far))
    set_at = F.when(F.col("m").isNotNull(), F.struct(F.col("m.v").alias("v"), (F.col("_all") - F.col("t") + F.col("m.at")).alias("at")))
    carried = counted.withColumn("_base", F.last(set_at, ignorenulls=True).over(so_far))
    after = F.coalesce("_base.v", F.lit(0)) + F.col("_all") - F.coalesce("_base.at", F.lit(0))
    entering = carried.select(*key, F.coalesce(F.lag(after % 2).over(along), F.lit(0)).alias("_in"))

    state = F.coalesce("_mark.v", F.col("_in")) + F.col("_turns") - F.coalesce("_mark.at", F.lit(0))
    ends = local.join(entering, key).withColumn("inside_after", state % 2 == 1)
    begins = F.coalesce(F.lag("inside_after").over(Window.partitionBy(*key).orderBy("seq")), F.col("_in") == 1)
    return ends.withColumn("inside", begins).drop("_set", "_turn", "_turns", "_mark", "_in")


def read_quoted(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """Rows (file, block, seq, cells) of files whose quoted cells may hold line ends, each file split over tasks.

    A row stands where its first line stands. Lines of one row are gathered; all others are rows as they are. When over
    ``ROW_LINES`` lines would make one row, its quote isn't one: each of its lines is a row, so that what follows isn't lost.
    """
    lines = inside_quotes(with_seq(_text(files(spark.read, glob).text(paths))))
    several = F.col("inside") | F.col("inside_after")
    found = accumulate(lines.where(several).select("file", "block", "seq", "text", "inside"), lasts={"row": F.when(~F.col("inside"), position())})
    sizes = found.groupBy("file", "row").agg((F.count(F.lit(1)) > ROW_LINES).alias("long"))
    sized = hot_key_join(found, sizes, ["file", "row"], "inner", salted=False)
    gathered = sized.where("not long").groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "text"))).alias("lines"))
    joined = gathered.select("file", "row.block", "row.seq", F.array_join("lines.text", "\n").alias("text"))
    columns = ("file", "block", "seq", "text")
    whole = lines.where(~several).select(*columns).unionByName(sized.where("long").select(*columns)).unionByName(joined)
    # in a row of its own, so that a filter doesn't repeat the split
    cells = F.inline(F.array(F.struct(_cells(F.col("text")).alias("cells"))))
    return whole.where(F.trim("text") != "").select("file", "block", "seq", cells)


def read_cells(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Rows of all CSV files below a path: file, block, seq, cells. Large files are split, those with quoted line ends too.

    One pass over the lines tells which files have any; the driver sees names of files, as it does when Spark lists them.
    """
    lines = files(spark.read, glob).text(path)
    quoted = open_quotes(lines)
    rest = sorted(set(lines.inputFiles()) - set(quoted))
    parts = []
    if rest:
        plain = path if not quoted else [_plain(f) for f in rest]
        parts.append(_rows(_text(files(spark.read, None if quoted else glob).text(plain))))
    if quoted:
        parts.append(read_quoted(spark, [_plain(f) for f in sorted(quoted)]))
    if not parts:
        return read_quoted(spark, path, glob)
    return reduce(lambda a, b: a.unionByName(b), parts)


def _plain(uri: str) -> str:
    """Path of a file by its URI."""
    return escaped(unquote(uri))


def escaped(path: str) -> str:
    """Characters that a glob would read as its own are escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def with_seq(rows: DataFrame) -> DataFrame:
    """Order of rows inside a block of a file: rows of a block are read in sequence by one task."""
    return rows.withColumn("seq", F.monotonically_increasing_id())


def position() -> Column:
    return F.struct("block", "seq")


@dataclass(frozen=True)
class HeaderRule:
    """How the header row of a file is recognised: every one of ``required`` is among its cells."""

    required: tuple[str, ...]

    def is_header(self, cells: Column) -> Column:
        test = F.lit(True)
        for name in self.required:
            test = test & F.coalesce(F.array_contains(cells, name), F.lit(False))
        return test


NO_HEADER = "no header row"


def per_file(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with what is known of their file, one row per file, as Spark lists them.

    The driver knows how many files were listed. When they are few the facts go to the rows, which stay in the tasks that read
    them; rows are neither shuffled by file, which gathers them in as many tasks as there are files, nor broadcast.
    """
    if 0 < len(rows.inputFiles()) <= CONFIG_ROWS:
        return rows.join(F.broadcast(facts), "file")
    return hot_key_join(rows, facts, ["file"], "inner")


def starts(rows: DataFrame) -> DataFrame:
    """file, _start: where the first row of each file stands. Numbers are aggregated first, so that rows are not sorted."""
    return rows.groupBy("file", "block").agg(F.min("seq").alias("seq")).groupBy("file").agg(F.min(position()).alias("_start"))


def with_header(rows: DataFrame, rule: HeaderRule, fields: tuple[str, ...] = ()) -> DataFrame:
    """Data rows with the column names of their file (``names``), and the places of ``fields``, found once per file, for ``placed``.

    Of a file without a header the first row is kept, without names, so that the readers can send it to quarantine. Only
    header rows and row numbers are aggregated.
    """
    headers = rows.where(rule.is_header(F.col("cells"))).select("file", "cells", position().alias("_at"))
    names = headers.groupBy("file").agg(trimmed(F.min_by("cells", "_at")).alias("names"))
    data = per_file(rows.where(~rule.is_header(F.col("cells"))), labelled(starts(rows).join(names, "file", "left")).withColumns(
        {f"_at_{n}": (F.nullif(F.array_position("names", n), F.lit(0)) - 1).cast("int") for n in fields}
    ))
    return data.where(F.col("names").isNotNull() | (position() == F.col("_start"))).drop("_start")


def valued(rows: DataFrame, texts: Column, values: Callable[[Column], Column], keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add the fields of ``values``, a struct made of the struct ``texts``; rows whose values don't meet ``keep`` go.

    Both are evaluated once per row. A filter on plain columns would be moved below them and repeat all that they are made of.
    """
    one = F.transform(F.array(texts), values)
    return rows.select("*", F.inline(one if keep is None else F.filter(one, keep)))


def trimmed(names: Column) -> Column:
    return F.transform(names, lambda n: F.trim(n))


def field(name: str) -> Column:
    """Cell of a named column, '' where the row is short and where the file has no such column."""
    at = F.array_position("names", name) - 1
    return F.coalesce(F.get("cells", at.cast("int")), F.lit(""))


def placed(name: str) -> Column:
    """``field`` of a column whose place is known."""
    return F.coalesce(F.get("cells", F.col(f"_at_{name}")), F.lit(""))


def labelled(facts: DataFrame) -> DataFrame:
    """Add to the names of each file what ``raw_map`` needs: places and names of its columns, of equal names the first one."""
    places = F.filter(
        F.sequence(F.lit(0), F.size("names") - 1),
        lambda i: (F.coalesce(F.get("names", i), F.lit("")) != "") & (F.array_position("names", F.get("names", i)) == i + 1),
    )
    placed = facts.withColumn("_places", F.when(F.size("names") > 0, places))
    return placed.withColumn("_labels", F.transform("_places", lambda i: F.get("names", i)))


def raw_map() -> Column:
    """The row as it was, by column name; unnamed cells are left out, and the first of equal names counts."""
    return F.map_from_arrays("_labels", F.transform("_places", lambda i: F.coalesce(F.get("cells", i), F.lit(""))))


def record(
    *,
    txn_date: Column,
    date_raw: Column,
    description: Column,
    amount: Column,
    source_type: str,
    source_rank: int,
    reject: Column,
    raw: Column,
    currency: Column | None = None,
    original_amount: Column | None = None,
    original_currency: Column | None = None,
    fee: Column | None = None,
    reference_id: Column | None = None,
) -> list[Column]:
    """RAW_TXN columns plus the reject reason."""
    null_text, null_money = F.lit(None).cast("string"), F.lit(None).cast(MONEY)

    def text(c: Column | None) -> Column:
        return null_text if c is None else c.cast("string")

    def money(c: Column | None) -> Column:
        return null_money if c is None else c.cast(MONEY)

    arrival = F.struct(
        F.lit(source_rank).cast("int").alias("source_rank"),
        S.file_base("file").alias("file_name"),
        F.col("block").cast("long").alias("block"),
        F.col("seq").cast("long").alias("seq"),
    )
    return [
        txn_date.alias("txn_date"),
        date_raw.alias("date_raw"),
        description.alias("description"),
        amount.cast(MONEY).alias("amount"),
        (F.lit("AUD") if currency is None else currency).alias("currency"),
        money(original_amount).alias("original_amount"),
        text(original_currency).alias("original_currency"),
        (F.lit(0).cast(MONEY) if fee is None else fee.cast(MONEY)).alias("fee"),
        text(reference_id).alias("reference_id"),
        F.lit(source_type).alias("source_type"),
        F.col("file").alias("source_file"),
        raw.alias("raw"),
        arrival.alias("arrival"),
        reject.alias(REJECT),
    ]


def unreadable_date(text: Column, parsed: Column) -> Column:
    return F.when((F.trim(text) != "") & parsed.isNull(), F.lit("unreadable date"))
