"""Sources, statement stitching, deduplication, sinks and streams.

File sources are exercised on files that Spark writes from the driver's tables to the shared scratch folder first.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyloom import config, jobs
from tallyloom.functions import scalars as S
from tallyloom.operators import accounts as ACC
from tallyloom.operators import fx as FX
from tallyloom.operators import normalize as N
from tallyloom.operators import stitch as ST
from tallyloom.operators.running import accumulate
from tallyloom.plans import dims, summaries
from tallyloom.session import scratch_path
from tallyloom.sinks.store import Store
from tallyloom.sources import csv_sources as CSV
from tallyloom.sources import lines as LN
from tallyloom.sources import openbanking as OB
from tallyloom.sources import registry as REG
from tallyloom.streaming.ingest import ingest_available
from workload import model as M
from workload import sqlmodel as Q
from workload.registry import query

DAY = Q.day("txn_date", "txn_date")
AMT = Q.money("amount", "amount")

# --- CSV and JSON sources --------------------------------------------------------------------------------------------


@query(
    "S01_read_ing_csv",
    f"""WITH {Q.RAW} SELECT CASE WHEN txn_id % 89 = 0 THEN NULL ELSE strftime(txn_date, '%Y-%m-%d') END AS txn_date, description, {AMT},
      CASE WHEN txn_id % 89 = 0 THEN 'unreadable date' END AS reject_reason FROM raw WHERE txn_id % 83 <> 0""",
)
def s01(spark, d):
    path = M.write_csv(M.ing_csv_rows(M.raw(spark, d)), scratch_path(spark, "ing"))
    return CSV.read_ing_csv(spark, path).select("txn_date", "description", "amount", "reject_reason")


@query("S02_read_bankwest_csv", f"WITH {Q.RAW} SELECT {DAY}, description, {AMT} FROM raw")
def s02(spark, d):
    path = M.write_csv(M.bankwest_csv_rows(M.raw(spark, d)), scratch_path(spark, "bankwest"))
    return CSV.read_bankwest_csv(spark, path).select("txn_date", "description", "amount")


@query(
    "S03_read_amex_csv",
    f"WITH {Q.FX} SELECT {DAY}, description, {AMT}, {Q.money('original_amount', 'original_amount')} FROM fx_raw",
)
def s03(spark, d):
    path = M.write_csv(M.amex_csv_rows(M.raw(spark, d)), scratch_path(spark, "amex"))
    return CSV.read_amex_csv(spark, path).select("txn_date", "description", "amount", "original_amount")


@query(
    "S04_read_airbnb_csv",
    f"""WITH {Q.RAW} SELECT {DAY}, concat('Airbnb - ', description) AS description, {AMT}, 3.5::DOUBLE AS fee,
      concat('HM', CAST(txn_id AS VARCHAR)) AS reference_id FROM raw""",
)
def s04(spark, d):
    path = M.write_csv(M.airbnb_csv_rows(M.raw(spark, d)), scratch_path(spark, "airbnb"))
    return CSV.read_airbnb_csv(spark, path).select("txn_date", "description", "amount", "fee", "reference_id")


PAYPAL = f"""{Q.FX}, conv AS (SELECT l_orderkey AS txn_id, bool_or(l_linenumber % 2 = 0) AS home FROM lineitem GROUP BY 1),
pp AS (SELECT f.*, COALESCE(c.home, FALSE) AS home, c.txn_id IS NOT NULL AS has_conv FROM fx_raw f LEFT JOIN conv c ON c.txn_id = f.txn_id
  WHERE f.txn_id % 41 <> 0 AND f.txn_id % 43 <> 0)"""
PAYPAL_AMOUNTS = """CAST(CASE WHEN is_foreign AND home THEN -(txn_id % 1000 + 1 + 0.25) WHEN is_foreign THEN original_amount ELSE amount END AS DOUBLE) AS amount,
  CASE WHEN is_foreign AND NOT home THEN 'USD' ELSE 'AUD' END AS currency,
  CAST(CASE WHEN is_foreign AND (home OR NOT has_conv) THEN original_amount END AS DOUBLE) AS original_amount,
  CASE WHEN is_foreign AND (home OR NOT has_conv) THEN 'USD' END AS original_currency"""


@query(
    "S05_read_paypal_csv",
    f"""WITH {PAYPAL} SELECT {DAY}, description, {PAYPAL_AMOUNTS}, 0.3::DOUBLE AS fee, concat('T', CAST(txn_id AS VARCHAR)) AS reference_id FROM pp""",
)
def s05(spark, d):
    rows = M.paypal_csv_rows(M.raw(spark, d), M.table(spark, d, "lineitem"))
    path = M.write_csv(rows, scratch_path(spark, "paypal"))
    return CSV.read_paypal_csv(spark, path).select(
        "txn_date", "description", "amount", "currency", "original_amount", "original_currency", "fee", "reference_id"
    )


@query(
    "J06_collapse_conversions",
    f"""WITH {Q.FX}, conv AS (SELECT l_orderkey AS txn_id, COUNT(*) AS n, arg_min(CAST(l_extendedprice AS DECIMAL(18,2)), (l_linenumber, l_partkey, l_suppkey, l_extendedprice))
        FILTER (l_returnflag = 'A' AND l_extendedprice <> 0) AS home FROM lineitem GROUP BY 1)
    SELECT f.txn_id, CAST(CASE WHEN is_foreign AND home IS NOT NULL THEN home WHEN is_foreign THEN original_amount ELSE amount END AS DOUBLE) AS amount,
      CAST(CASE WHEN is_foreign AND (home IS NOT NULL OR n IS NULL) THEN original_amount END AS DOUBLE) AS original_amount
    FROM fx_raw f LEFT JOIN conv c ON c.txn_id = f.txn_id""",
)
def j06(spark, d):
    from tallyloom.operators.conversions import collapse_conversions

    raw = M.raw(spark, d)
    payments = raw.select(
        F.lit("all").alias("file"),
        F.concat(F.lit("T"), F.col("txn_id").cast("string")).alias("txn_ref"),
        F.lit("").alias("parent_ref"),
        F.coalesce("original_currency", F.lit("AUD")).alias("currency"),
        F.coalesce("original_amount", "amount").alias("gross"),
        F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), F.col("txn_id").cast("double").alias("d")).alias("arrival"),
        F.lit(False).alias("conv"),
        "txn_id",
    )
    lines = M.table(spark, d, "lineitem").select(
        F.lit("all"),
        F.concat(F.lit("C"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")),
        F.concat(F.lit("T"), F.col("l_orderkey").cast("string")),
        F.when(F.col("l_returnflag") == "A", "AUD").otherwise("USD"),
        F.col("l_extendedprice").cast("decimal(18,2)"),
        F.struct(F.col("l_linenumber").alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c"), F.col("l_extendedprice").alias("d")),
        F.lit(True),
        F.lit(None).cast("long"),
    )
    out = collapse_conversions(payments.union(lines), F.col("conv"), F.lit(True))
    return out.select("txn_id", "amount", "original_amount")


@query(
    "S06_read_openbanking_json",
    f"""WITH {Q.RAW} SELECT concat('basiq:', CAST(txn_id AS VARCHAR)) AS reference_id, {DAY}, description, {AMT},
      CASE WHEN amount > 0 THEN 'credit' ELSE 'debit' END AS direction FROM raw WHERE txn_id % 17 <> 0""",
)
def s06(spark, d):
    path = scratch_path(spark, "openbanking")
    M.openbanking_rows(M.raw(spark, d)).write.json(path)
    rows = OB.read_openbanking_json(spark, path, "ing")
    return rows.select("reference_id", "txn_date", "description", "amount", F.col("raw")["direction"].alias("direction"))


# --- statements ------------------------------------------------------------------------------------------------------


def _statement(spark, d, make, stitch, label):
    path = M.write_text(make(M.raw(spark, d)), scratch_path(spark, label))
    return stitch(LN.read_lines(spark, path)).select("txn_date", "description", "amount")


@query(
    "S07_stitch_ing",
    f"WITH {Q.RAW} SELECT {DAY}, concat('Purchase ', description, ' Card 1234') AS description, {AMT} FROM raw",
)
def s07(spark, d):
    return _statement(spark, d, M.ing_text_rows, ST.stitch_ing, "ing-text")


@query(
    "S08_stitch_bankwest",
    f"""WITH {Q.RAW} SELECT strftime(CASE WHEN year(txn_date) < 2000 THEN txn_date + INTERVAL 100 YEAR ELSE txn_date END, '%Y-%m-%d') AS txn_date,
      concat(description, CASE WHEN amount > 0 THEN ' REFUND' ELSE '' END, CASE WHEN is_foreign THEN ' (12.99 USD)' ELSE '' END) AS description, {AMT} FROM raw""",
)
def s08(spark, d):
    return _statement(spark, d, M.bankwest_text_rows, ST.stitch_bankwest, "bankwest-text")


@query("S09_stitch_hsbc", f"WITH {Q.RAW} SELECT {DAY}, concat(description, ' Ref no') AS description, {AMT} FROM raw")
def s09(spark, d):
    return _statement(spark, d, M.hsbc_text_rows, ST.stitch_hsbc, "hsbc-text")


@query("S10_stitch_coles", f"WITH {Q.RAW} SELECT {DAY}, description, {AMT} FROM raw")
def s10(spark, d):
    return _statement(spark, d, M.coles_text_rows, ST.stitch_coles, "coles-text")


# Every line of every document, some of them replaced: dates, headers, footers, noise. n counts lines from 0.
DOC_LINES = """doc AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
raw_lines AS (SELECT doc_id, unnest(range(len(parts))) AS n, unnest(parts) AS body FROM doc),
lines AS (SELECT doc_id, n, trim(regexp_replace(CASE WHEN (doc_id + n) % 5 = 0 THEN concat('01/02/2003 ', body)
      WHEN (doc_id + n) % 7 = 3 THEN 'Date  Details  Money out $' WHEN (doc_id + n) % 11 = 6 THEN 'Always here to help'
      WHEN (doc_id + n) % 13 = 4 THEN 'Page 1 of 2' ELSE body END, '^\\s+|\\s+$', '', 'g')) AS text FROM raw_lines),
kinds AS (SELECT doc_id, n, text, CASE WHEN text = '' THEN NULL WHEN regexp_matches(text, '^Date\\s+Details\\s+(Money|Debit)') THEN 'H'
      WHEN text = 'Page 1 of 2' THEN 'N' WHEN regexp_matches(text, '^\\d{2}/\\d{2}/\\d{4}\\s+(.+)') THEN 'D'
      WHEN text = 'Always here to help' THEN 'F' ELSE 'T' END AS kind FROM lines)"""


def _doc_lines(spark, d):
    base = LN.lines_of_texts(M.table(spark, d, "documents"), "doc_id", "text")
    at = F.col("file").cast("long") + F.col("seq")
    text = (
        F.when(at % 5 == 0, F.concat(F.lit("01/02/2003 "), F.col("text")))
        .when(at % 7 == 3, "Date  Details  Money out $")
        .when(at % 11 == 6, "Always here to help")
        .when(at % 13 == 4, "Page 1 of 2")
        .otherwise(F.col("text"))
    )
    return base.withColumn("text", text)


def _keyed(rows, *more):
    return rows.select(F.col("file").cast("long").alias("doc_id"), F.col("seq").alias("n"), *more)


@query(
    "L01_section_detect",
    f"""WITH RECURSIVE {DOC_LINES}, ev AS (SELECT doc_id, kind, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i FROM kinds WHERE kind IN ('H', 'D', 'F', 'T')),
    st AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, 0 AS s FROM doc UNION ALL
      SELECT e.doc_id, e.i, CASE WHEN e.kind = 'H' THEN CASE WHEN s = 0 THEN 1 ELSE s END WHEN e.kind = 'D' THEN CASE WHEN s = 0 THEN 0 ELSE 2 END
        WHEN e.kind = 'F' THEN CASE WHEN s = 2 THEN 0 ELSE s END ELSE s END FROM st JOIN ev e ON e.doc_id = st.doc_id AND e.i = st.i + 1)
    SELECT ev.doc_id, ev.n FROM st JOIN ev ON ev.doc_id = st.doc_id AND ev.i = st.i WHERE st.s > 0 AND ev.kind IN ('D', 'T')""",
)
def l01(spark, d):
    return _keyed(ST.in_section(ST.mark_lines(_doc_lines(spark, d), ST.ING)))


@query(
    "L02_noise_filter",
    f"""WITH {DOC_LINES} SELECT doc_id, n FROM kinds WHERE kind IN ('D', 'T', 'F')""",
)
def l02(spark, d):
    lines = _doc_lines(spark, d).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    kind = ST.line_kind(ST.ING)
    return _keyed(lines.where((F.col("text") != "") & ~kind.isin(ST.HEAD, ST.NOISE)))


@query(
    "L03_entry_start",
    f"""WITH {DOC_LINES} SELECT doc_id, n, kind, CAST(SUM(CASE WHEN kind = 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS entry
      FROM kinds QUALIFY kind IS NOT NULL""",
)
def l03(spark, d):
    return _keyed(ST.mark_lines(_doc_lines(spark, d), ST.ING), "kind", "entry")


@query(
    "W03_running_and_carry",
    f"""WITH {DOC_LINES} SELECT doc_id, n, CAST(SUM(length(text)) OVER w AS BIGINT) AS chars,
      last_value(CASE WHEN kind = 'D' THEN n END IGNORE NULLS) OVER w AS last_date FROM kinds
      WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)""",
)
def w03(spark, d):
    lines = _doc_lines(spark, d).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    dated = F.when(F.col("text").rlike(ST.ING_DATE), F.col("seq"))
    out = accumulate(lines, sums={"chars": F.length("text").cast("long")}, lasts={"last_date": dated})
    return _keyed(out, "chars", "last_date")


@query(
    "L04_continuation_merge",
    f"""WITH {DOC_LINES}, e AS (SELECT *, SUM(CASE WHEN kind = 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS entry FROM kinds)
    SELECT doc_id, min(n) AS n, count(*) AS lines, md5(string_agg(text, chr(10) ORDER BY n)) AS digest FROM e WHERE kind IN ('D', 'T') AND entry > 0 GROUP BY doc_id, entry""",
)
def l04(spark, d):
    marked = ST.mark_lines(_doc_lines(spark, d), ST.ING).where(F.col("kind").isin(ST.DATE, ST.TEXT))
    found = ST.entries(marked)
    text = F.array_join(F.transform("lines", lambda e: e["text"]), "\n")
    return _keyed(found, F.size("lines").cast("long").alias("lines"), F.md5(text).alias("digest"))


AMOUNT_LINE = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_quantity AS DECIMAL(18,2)) AS qty,
  CAST(l_tax AS DECIMAL(18,2)) AS tax, l_partkey % 4 AS c FROM lineitem"""


@query(
    "L05_amount_columns",
    f"""WITH x AS ({AMOUNT_LINE}) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CAST(CASE c WHEN 0 THEN -price WHEN 1 THEN price WHEN 2 THEN (CASE WHEN price <> 0 THEN -price WHEN qty <> 0 THEN qty END) ELSE NULL END AS DOUBLE) AS ing,
      CAST(CASE c WHEN 0 THEN -price WHEN 1 THEN -price WHEN 2 THEN CASE WHEN qty > 0 THEN qty ELSE -price END ELSE -tax END AS DOUBLE) AS hsbc,
      CASE c WHEN 3 THEN 'X 12' WHEN 2 THEN 'Item' ELSE concat('Item ', CAST(l_partkey AS VARCHAR)) END AS ing_rest
    FROM x""",
)
def l05(spark, d):
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    qty = F.col("l_quantity").cast("decimal(18,2)").cast("string")
    item = F.concat(F.lit("Item "), F.col("l_partkey").cast("string"), F.lit(" "))
    tax = F.col("l_tax").cast("decimal(18,2)").cast("string")
    case = F.col("l_partkey") % 4
    text = (
        F.when(case == 0, F.concat(item, F.lit("-"), price, F.lit("   "), qty))
        .when(case == 1, F.concat(item, price, F.lit("   "), qty))
        .when(case == 2, F.concat(F.lit("Item "), price, F.lit("  "), qty, F.lit("  "), F.lit("7.00")))
        .otherwise(F.concat(F.lit("X 12 "), tax))
    )
    rows = M.table(spark, d, "lineitem").withColumn("text", text)
    rows = ST.with_ing_columns(rows, "text", "ing").withColumn("hsbc", ST.hsbc_amount(F.col("text"), case == 1))
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("ing.amount").alias("ing"),
        F.col("hsbc.amount").alias("hsbc"),
        F.coalesce(F.col("ing.rest"), F.lit("X 12")).alias("ing_rest"),
    )


@query(
    "L06_statement_attributes",
    f"""WITH {Q.RAW}, y AS (SELECT account_id, arg_min(year(txn_date), txn_id) FILTER (txn_id % 3 = 0) AS y, arg_min(abs(amount), txn_id) FILTER (txn_id % 2 = 0) AS b FROM raw GROUP BY 1)
    SELECT account_id, COALESCE(CAST(y AS VARCHAR), '2025') AS year, {Q.money('b', 'closing_balance')} FROM y""",
)
def l06(spark, d):
    period = F.concat(F.lit("01 Jan "), F.date_format("txn_date", "yyyy"), F.lit(" to 31 Jan 2020"))
    text = F.concat(
        F.when(F.col("txn_id") % 3 == 0, period).otherwise("nothing"),
        F.when(F.col("txn_id") % 2 == 0, F.concat(F.lit(" Closing Balance $"), F.format_number(F.abs("amount"), 2))).otherwise(""),
    )
    lines = M.raw(spark, d).select(
        F.col("account_id").cast("string").alias("file"), F.lit(0).alias("block"), F.col("txn_id").alias("seq"), text.alias("text")
    )
    out = ST.hsbc_attributes(ST.mark_lines(lines, ST.HSBC))
    balance = F.regexp_replace("closing_balance", ",", "").cast("decimal(18,2)")
    return out.select(F.col("file").cast("long").alias("account_id"), "year", balance.alias("closing_balance"))


@query("L07_post_date_strip", f"WITH {Q.RAW} SELECT txn_id, description AS rest FROM raw")
def l07(spark, d):
    formats = (F.date_format("txn_date", "dd MMM"), F.date_format("txn_date", "d/MM/yy"), F.date_format("txn_date", "MMM dd"))
    prefix = F.when(F.col("txn_id") % 3 == 0, formats[0]).when(F.col("txn_id") % 3 == 1, formats[1]).otherwise(formats[2])
    text = F.concat(prefix, F.lit("  "), F.col("description"))
    return M.raw(spark, d).select("txn_id", ST.strip_post_date(text).alias("rest"))


# --- staging, accounts, configuration --------------------------------------------------------------------------------


def _stage(spark, d):
    """Every transaction as a line of a statement of its source: five folders, four formats."""
    root = scratch_path(spark, "staging")
    rows = M.raw(spark, d)

    def of(source):
        return rows.where(F.col("source_type") == source)

    M.write_csv(M.bankwest_csv_rows(of("ing")), f"{root}/bankwest-csv")
    M.write_csv(M.amex_csv_rows(of("amex")), f"{root}/amex")
    M.write_csv(M.airbnb_csv_rows(of("airbnb")), f"{root}/airbnb")
    M.write_text(M.hsbc_text_rows(of("hsbc")), f"{root}/hsbc")
    M.write_text(M.coles_text_rows(of("paypal")), f"{root}/coles")
    return root


STAGED = f"""staged AS (SELECT txn_id, txn_date, amount, CASE source_type WHEN 'ing' THEN 'bankwest' WHEN 'paypal' THEN 'coles' ELSE source_type END AS source_type,
    CASE source_type WHEN 'airbnb' THEN concat('Airbnb - ', description) WHEN 'hsbc' THEN concat(description, ' Ref no') ELSE description END AS description FROM raw)"""


@query("S11_scan_staging", f"WITH {Q.RAW}, {STAGED} SELECT source_type, {DAY}, description, {AMT} FROM staged")
def s11(spark, d):
    return REG.scan_staging(spark, _stage(spark, d)).select("source_type", "txn_date", "description", "amount")


@query("U01_one_source", f"WITH {Q.RAW}, {STAGED} SELECT {DAY}, description, {AMT} FROM staged WHERE source_type = 'amex'")
def u01(spark, d):
    return REG.scan_staging(spark, _stage(spark, d), only="amex").select("txn_date", "description", "amount")


PREFIXES = (config.Account("Ten", "x", file_prefix="amex_10"), config.Account("One", "x", file_prefix="amex_1"), config.Account("Hs", "x", file_prefix="hsbc_"))


@query(
    "S12_resolve_account",
    f"""WITH {Q.RAW} SELECT txn_id, CASE WHEN source_file LIKE '/in/amex\\_10%' ESCAPE '\\' THEN 'Ten' WHEN source_file LIKE '/in/amex\\_1%' ESCAPE '\\' THEN 'One'
      WHEN source_file LIKE '/in/hsbc\\_%' ESCAPE '\\' THEN 'Hs' WHEN source_type = 'paypal' THEN 'PayPal' WHEN source_type = 'ing' THEN 'ING Orange Everyday'
      WHEN source_type = 'airbnb' THEN 'Airbnb' ELSE 'Amex' END AS account FROM raw""",
)
def s12(spark, d):
    account = ACC.resolve_account(PREFIXES, file_name=S.file_base("source_file"))
    return M.raw(spark, d).select("txn_id", account.alias("account"))


@query(
    "J09b_prefix_table",
    f"""WITH {Q.RAW}, p AS (SELECT concat(source_type, '_', CAST(account_id AS VARCHAR)) AS prefix, account_id AS ord FROM accounts),
    f AS (SELECT DISTINCT source_type, account_id FROM raw)
    SELECT r.txn_id, (SELECT min(x) FROM (SELECT unnest([CASE WHEN (r.account_id // k) % 5 = r.account_id % 5 OR k = 1 THEN r.account_id // k END FOR k IN [1, 10, 100, 1000, 10000, 100000] IF r.account_id // k > 0 OR k = 1]) AS x)) AS owner
    FROM raw r""",
)
def j09b(spark, d):
    prefixes = M.accounts(spark, d).select(
        F.concat("source_type", F.lit("_"), F.col("account_id").cast("string")).alias("prefix"),
        F.col("account_id").alias("owner"),
        F.col("account_id").alias("ord"),
    )
    rows = M.raw(spark, d).select("txn_id", S.file_base("source_file").alias("file_name"))
    found = ACC.resolve_account_by_table(rows, prefixes.withColumnRenamed("owner", "account_id"))
    return found.select("txn_id", F.col("account_id").alias("owner"))


@query(
    "S13_load_dims",
    f"""WITH {Q.TXN}, c AS (SELECT * FROM (VALUES ('Airbnb Income', TRUE, NULL), ('Business: Software', FALSE, NULL), ('Groceries', FALSE, 600), ('Salary', TRUE, NULL),
      ('Transfers', FALSE, NULL), ('Uncategorized', FALSE, NULL), ('Utilities', FALSE, 300), ('Strata', FALSE, 50)) v(category, is_income, budget))
    SELECT c.category, is_income, CAST(budget AS DOUBLE) AS budget_monthly, COUNT(t.txn_id) AS n FROM c LEFT JOIN txn t ON t.category = c.category GROUP BY 1, 2, 3""",
)
def s13(spark, d):
    counts = M.txns(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    frame = dims.categories_frame(spark, M.SETTINGS.categories)
    return frame.join(counts, "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(
    "S14_payment_patterns",
    f"""WITH {Q.RAW} SELECT source_type, source_type IN ('paypal', 'hsbc') AS trusted, COUNT(*) FILTER (regexp_matches(description, 'STORE 7$')) AS matching FROM raw GROUP BY 1, 2""",
)
def s14(spark, d):
    from tallyloom.operators.rules import matches

    patterns, trusted = config.payment_patterns(M.SETTINGS.accounts)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | matches(F.upper("description"), p)
    rows = M.raw(spark, d).withColumn("trusted", F.col("source_type").isin(*sorted(trusted)))
    return rows.groupBy("source_type", "trusted").agg(F.count_if(hit).alias("matching"))


SINCE = f"""{Q.RAW}, old AS (SELECT source_type, MAX(txn_date) AS since FROM raw WHERE txn_id % 10 = 0 AND txn_date < DATE '1998-01-01' AND source_type <> 'amex' GROUP BY 1)"""


@query(
    "S15_incremental_since",
    f"""WITH {SINCE} SELECT r.txn_id, strftime(r.txn_date, '%Y-%m-%d') AS txn_date FROM raw r LEFT JOIN old o ON o.source_type = r.source_type
      WHERE o.since IS NULL OR r.txn_date >= o.since""",
)
def s15(spark, d):
    rows = M.raw(spark, d)
    return OB.incremental_since(rows, _synced(rows)).select("txn_id", "txn_date")


def _synced(rows):
    """A store whose older rows came from the aggregator, one in ten, for all but one source."""
    marked = (F.col("txn_id") % 10 == 0) & (F.col("txn_date") < F.lit(dt.date(1998, 1, 1))) & (F.col("source_type") != "amex")
    return rows.withColumn("reference_id", F.when(marked, F.concat(F.lit("basiq:"), F.col("txn_id").cast("string"))))


@query("A20_max_date_per_source", f"WITH {SINCE} SELECT source_type, strftime(since, '%Y-%m-%d') AS since FROM old")
def a20(spark, d):
    return OB.last_synced(_synced(M.raw(spark, d)))


# --- identity, first copies, normalisation ---------------------------------------------------------------------------

HASHED = f"""{Q.TXN}, hashed AS (SELECT *, sha256(CASE WHEN source_type = 'paypal' THEN concat('T', CAST(txn_id AS VARCHAR))
    WHEN source_type = 'ing' THEN concat(strftime(txn_date, '%Y-%m-%d'), '|', description, '|', regexp_replace(CAST(amount AS VARCHAR), '0$', ''), '|', source_type, '_', CAST(account_id AS VARCHAR))
    ELSE concat(strftime(txn_date, '%Y-%m-%d'), '|', description, '|', regexp_replace(CAST(amount AS VARCHAR), '0$', '')) END) AS dedup_hash FROM txn),
firsts AS (SELECT * FROM hashed QUALIFY row_number() OVER (PARTITION BY dedup_hash ORDER BY txn_id) = 1)"""


def _copies(spark, d):
    """Two overlapping batches: everything, and once more, later, all from 1997 on and every earlier Groceries-like row."""
    rows = M.raw(spark, d)
    again = rows.where((F.col("txn_date") >= F.lit(dt.date(1997, 1, 1))) | F.col("description").contains("NOT SPECIFIED"))
    return M.records(rows, 0).unionByName(M.records(again, 1)).unionByName(M.records(rows, 2))


@query("W02_first_copy", f"WITH {HASHED} SELECT dedup_hash, 0.0::DOUBLE AS fee, {AMT} FROM firsts")
def w02(spark, d):
    return N.first_copies(N.with_identity(N.accepted(_copies(spark, d)))).select("dedup_hash", "fee", "amount")


@query("J13_unseen", f"WITH {HASHED} SELECT dedup_hash FROM firsts WHERE dedup_hash NOT IN (SELECT dedup_hash FROM hashed WHERE txn_date < DATE '1998-07-01')")
def j13(spark, d):
    known = N.with_identity(M.records(M.raw(spark, d).where(F.col("txn_date") < F.lit(dt.date(1998, 7, 1)))))
    new = N.first_copies(N.with_identity(N.accepted(_copies(spark, d))))
    return N.unseen(new, known).select("dedup_hash")


@query(
    "R09_normalize",
    f"""WITH {HASHED} SELECT dedup_hash, {DAY}, description, {AMT}, category, {Q.money('confidence', 'confidence')}, is_transfer, array_to_string(tags, ',') AS tags, CAST(fy AS BIGINT) AS fy
      FROM firsts WHERE dedup_hash NOT IN (SELECT dedup_hash FROM hashed WHERE txn_date < DATE '1996-07-01')""",
)
def r09(spark, d):
    known = N.with_identity(M.records(M.raw(spark, d).where(F.col("txn_date") < F.lit(dt.date(1996, 7, 1)))))
    new = N.normalize(_copies(spark, d), M.SETTINGS, known).new
    return new.select("dedup_hash", "txn_date", "description", "amount", "category", "confidence", "is_transfer", "tags", "fy")


@query(
    "P09_quarantine",
    f"""WITH {Q.RAW} SELECT 'unreadable date' AS reject_reason, COUNT(*) AS n FROM raw WHERE txn_id % 83 <> 0 AND txn_id % 89 = 0
      UNION ALL SELECT 'accepted', COUNT(*) FROM raw WHERE txn_id % 83 <> 0 AND txn_id % 89 <> 0""",
)
def p09(spark, d):
    path = M.write_csv(M.ing_csv_rows(M.raw(spark, d)), scratch_path(spark, "ing"))
    rows = CSV.read_ing_csv(spark, path)
    reason = F.coalesce("reject_reason", F.lit("accepted")).alias("reject_reason")
    return rows.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


@query("U02_union_sources", f"WITH {Q.RAW} SELECT source_type, COUNT(*) AS n, {Q.money('SUM(amount)', 'total')} FROM raw GROUP BY 1")
def u02(spark, d):
    rows = M.raw(spark, d)
    parts = [M.records(rows.where(F.col("source_type") == s), i) for i, s in enumerate(("ing", "paypal", "hsbc", "amex", "airbnb"))]
    return REG.union_sources(parts).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), summaries.money_sum().alias("total"))


FX_FIRST = f"""{Q.FX}, r AS (SELECT txn_date, txn_id, round(abs(CAST(amount AS DOUBLE)) / abs(CAST(original_amount AS DOUBLE)), 6) AS rate FROM fx_raw
    WHERE is_foreign AND amount <> 0 AND abs(amount) <> abs(original_amount))"""


@query("R10_extract_fx", f"WITH {FX_FIRST} SELECT {DAY}, 'USD' AS from_currency, 'AUD' AS to_currency, arg_min(rate, txn_id) AS rate FROM r GROUP BY txn_date")
def r10(spark, d):
    return FX.extract_fx(M.raw(spark, d))


@query(
    "K03_upsert_fx",
    f"""WITH {FX_FIRST} SELECT {DAY}, 'USD' AS from_currency, COALESCE(CASE WHEN MIN(CASE WHEN txn_id % 2 = 0 THEN 1 END) = 1 THEN 1.5::DOUBLE END, arg_min(rate, txn_id)) AS rate FROM r GROUP BY txn_date""",
)
def k03(spark, d):
    rows = M.raw(spark, d)
    existing = FX.extract_fx(rows.where(F.col("txn_id") % 2 == 0)).withColumn("rate", F.lit("1.5").cast("decimal(18,6)"))
    return FX.upsert_fx(existing, FX.extract_fx(rows)).select("txn_date", "from_currency", "rate")


# --- store, jobs, streams --------------------------------------------------------------------------------------------


STORED = f"WITH {HASHED} SELECT dedup_hash, {DAY}, {AMT}, category, is_transfer, CAST(fy AS BIGINT) AS fy, 0.0::DOUBLE AS fee FROM firsts"


def _two_ingests(spark, d) -> Store:
    """A first batch up to 1997, then everything, with copies."""
    rows = M.raw(spark, d)
    root = scratch_path(spark, "store")
    Store(spark, root).ingest(M.records(rows.where(F.col("txn_date") < F.lit(dt.date(1998, 1, 1))), 0), M.SETTINGS, batch_id=1)
    Store(spark, root).ingest(M.records(rows, 0).unionByName(M.records(rows, 1)), M.SETTINGS, batch_id=2)
    return Store(spark, root)


@query("K01_append_transactions", STORED)
def k01(spark, d):
    return _two_ingests(spark, d).transactions().select("dedup_hash", "txn_date", "amount", "category", "is_transfer", "fy", "fee")


@query("K02_raw_audit", f"WITH {HASHED} SELECT dedup_hash, CAST(amount AS VARCHAR) AS balance FROM firsts")
def k02(spark, d):
    return _two_ingests(spark, d).with_raw().select("dedup_hash", F.col("raw")["balance"].alias("balance"))


@query(
    "K05b_backfill_store",
    f"""WITH {Q.SPLITS} SELECT business, {Q.money('SUM(business_amount)', 'total')}, COUNT(*) AS n FROM splits WHERE fy IN (1998, 1999) GROUP BY 1""",
)
def k05b(spark, d):
    rows = M.raw(spark, d)
    store = Store(spark, scratch_path(spark, "store"))
    keyed = M.records(rows).withColumn("reference_id", F.concat(F.lit("basiq:"), F.col("arrival.seq").cast("string")))
    store.ingest(keyed, M.SETTINGS)
    for year in (1998, 1999, 1998):
        store.backfill_splits(M.SETTINGS, year)
    return store.splits().groupBy("business").agg(summaries.money_sum("business_amount").alias("total"), F.count(F.lit(1)).alias("n"))


@query("K07_dry_run", f"WITH {Q.RAW}, {STAGED}, f AS (SELECT DISTINCT txn_date, description, amount FROM staged) SELECT {DAY}, substr(description, 1, 40) AS description, {AMT} FROM f")
def k07(spark, d):
    preview = jobs.dry_run(spark, _stage(spark, d), scratch_path(spark, "store"), M.SETTINGS)
    return preview.select("txn_date", F.col("description"), "amount")


@query(
    "K08_rebuild_coverage",
    f"WITH {Q.RAW}, {STAGED}, f AS (SELECT DISTINCT txn_date, description, amount FROM staged) SELECT COUNT(*) AS total FROM f",
)
def k08(spark, d):
    _, coverage = jobs.rebuild(spark, _stage(spark, d), scratch_path(spark, "store"), M.SETTINGS)
    return coverage.select("total")


STREAMED = f"WITH {Q.RAW}, {STAGED}, f AS (SELECT DISTINCT txn_date, description, amount FROM staged) SELECT {DAY}, description, {AMT} FROM f"


@query("X01_stream_ingest", STREAMED)
def x01(spark, d):
    store, check = scratch_path(spark, "store"), scratch_path(spark, "check")
    ingest_available(spark, _stage(spark, d), store, M.SETTINGS, check)
    return Store(spark, store).transactions().select("txn_date", "description", "amount")


@query(
    "K06_archive_inputs",
    f"""WITH {Q.RAW}, k AS (SELECT DISTINCT {DAY}, description, {AMT} FROM raw)
      SELECT 'store' AS place, k.* FROM k UNION ALL SELECT 'archive', k.* FROM k""",
)
def k06(spark, d):
    """Two runs of one stream; the files of both stand in the archive afterwards and none in staging."""
    staging, store, check, archive = (scratch_path(spark, n) for n in ("staging", "store", "check", "archive"))
    rows = M.raw(spark, d)
    border = F.lit(dt.date(1998, 1, 1))
    for i, part in enumerate((rows.where(F.col("txn_date") < border), rows.where(F.col("txn_date") >= border))):
        M.write_csv(M.amex_csv_rows(part), f"{staging}/amex/run{i}")
        ingest_available(spark, staging, store, M.SETTINGS, check, sources=("amex",), archive=archive)
    columns = ("txn_date", "description", "amount")
    places = {"store": Store(spark, store).transactions(), "archive": CSV.read_amex_csv(spark, archive), "staging": CSV.read_amex_csv(spark, staging)}
    return REG.union_sources([rows.select(*columns).distinct().select(F.lit(place).alias("place"), *columns) for place, rows in places.items()])


@query("X02_dedup_across_batches", f"WITH {Q.RAW} SELECT DISTINCT {DAY}, description, {AMT} FROM raw")
def x02(spark, d):
    """The same statements land in a second folder, read by a new stream; the table does not change."""
    store = scratch_path(spark, "store")
    for _ in range(2):
        staging = scratch_path(spark, "staging")
        M.write_csv(M.amex_csv_rows(M.raw(spark, d)), f"{staging}/amex")
        ingest_available(spark, staging, store, M.SETTINGS, scratch_path(spark, "check"), sources=("amex",))
    return Store(spark, store).transactions().select("txn_date", "description", "amount")


@query(
    "X03_replay_safety",
    f"WITH {HASHED} SELECT 'first' AS run, COUNT(*) AS inserted FROM firsts UNION ALL SELECT 'again', 0",
)
def x03(spark, d):
    store = Store(spark, scratch_path(spark, "store"))
    records = M.records(M.raw(spark, d))
    first = store.ingest(records, M.SETTINGS, batch_id=7)
    again = store.ingest(records, M.SETTINGS, batch_id=7)
    return spark.createDataFrame([("first", first.inserted), ("again", again.inserted)], "run string, inserted long")


@query(
    "X04_late_data",
    f"""WITH {HASHED} SELECT strftime(txn_date, '%Y-%m') AS month, {Q.money('SUM(CASE WHEN amount < 0 THEN amount ELSE 0 END)', 'expenses')},
      {Q.money('SUM(CASE WHEN amount > 0 THEN amount ELSE 0 END)', 'income')} FROM firsts WHERE NOT is_transfer GROUP BY 1""",
)
def x04(spark, d):
    """Years arrive newest first; the summary is that of all rows."""
    store = Store(spark, scratch_path(spark, "store"))
    rows = M.raw(spark, d)
    border = F.lit(dt.date(1998, 1, 1))
    store.ingest(M.records(rows.where(F.col("txn_date") >= border)), M.SETTINGS, batch_id=1)
    store.ingest(M.records(rows.where(F.col("txn_date") < border)), M.SETTINGS, batch_id=2)
    return summaries.monthly_summary(store.transactions(), exclude_loans=False)


# --- extension points ------------------------------------------------------------------------------------------------


@query("V01_new_source", "SELECT CAST(ts AS DATE)::VARCHAR AS txn_date, event_type AS description, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM events")
def v01(spark, d):
    """A source of one's own: the events table as a bank feed."""
    from tallyloom.sources.cells import record

    def parse(rows):
        day = F.col("ts").cast("date")
        return rows.select(
            *record(
                txn_date=day,
                date_raw=F.date_format(day, "yyyy-MM-dd"),
                description=F.col("event_type"),
                amount=F.col("value"),
                source_type="events",
                source_rank=20,
                reject=F.lit(None).cast("string"),
                raw=F.create_map(F.lit("props"), F.col("props")),
            )
        )

    def read(session, root, glob):
        rows = M.table(session, root.removesuffix("/."), "events")
        return rows.select("*", F.lit("events").alias("file"), F.lit(0).alias("block"), F.col("event_id").alias("seq"))

    registry = {}
    REG.register(REG.Source("events", ".", "*.parquet", read, parse), registry)
    return REG.scan_staging(spark, d, registry=registry).select("txn_date", "description", "amount")


@query(
    "V02_user_rules",
    f"""WITH {Q.RAW} SELECT txn_id, CASE WHEN source_type = 'amex' AND regexp_matches(description, 'STORE [0-4]+$') THEN 'Travel' WHEN regexp_matches(description, 'BUILDING|MACHINERY') THEN 'Trade'
      ELSE 'Uncategorized' END AS category FROM raw""",
)
def v02(spark, d):
    from tallyloom.operators.rules import classify

    settings = config.Settings(
        categories=tuple(config.Category(n) for n in ("Travel", "Trade", "Uncategorized")),
        rules=(config.Rule("regex", "Travel", "store [0-4]+$", "amex"), config.Rule("regex", "Trade", "building|machinery")),
    )
    return classify(M.raw(spark, d), settings).select("txn_id", "category")


@query(
    "V03_post_ingest_hook",
    f"""WITH {HASHED} SELECT dedup_hash, CASE WHEN amount < -400000 THEN 'Strata' ELSE category END AS category FROM firsts""",
)
def v03(spark, d):
    def large(df):
        return df.withColumn("category", F.when(F.col("amount") < -400000, "Strata").otherwise(F.col("category")))

    return N.normalize(M.records(M.raw(spark, d)), M.SETTINGS, hooks=[large]).new.select("dedup_hash", "category")
