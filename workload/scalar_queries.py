"""Column functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from workload import model as M
from workload import sqlmodel as Q
from workload.registry import query

BAD_DAY = "o_orderkey % 97 = 0"


def _orders(spark, d):
    return M.table(spark, d, "orders")


def _day():
    return F.col("o_orderdate").cast("date")


@query(
    "F01_parse_dmy",
    f"""SELECT o_orderkey, CASE WHEN {BAD_DAY} THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders""",
)
def f01(spark, d):
    text = F.when(F.col("o_orderkey") % 97 == 0, "31/02/1999").otherwise(F.date_format(_day(), "d/M/yyyy"))
    return _orders(spark, d).select("o_orderkey", S.parse_dmy(text).alias("parsed"))


@query(
    "F02_parse_dmy2",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE
      strftime(CASE WHEN o_orderkey % 4 = 1 AND year(o_orderdate) < 2000 THEN o_orderdate + INTERVAL 100 YEAR ELSE o_orderdate END, '%Y-%m-%d') END
      AS parsed FROM orders""",
)
def f02(spark, d):
    case = F.col("o_orderkey") % 4
    text = (
        F.when(case == 0, F.date_format(_day(), "dd/MM/yyyy"))
        .when(case == 1, F.date_format(_day(), "d/M/yy"))
        .when(case == 2, F.date_format(_day(), "yyyy-MM-dd"))
        .otherwise(F.date_format(_day(), "MMM yyyy"))
    )
    return _orders(spark, d).select("o_orderkey", S.parse_dmy2(text).alias("parsed"))


@query(
    "F03_parse_dmon",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE strftime(
      CASE WHEN o_orderkey % 7 = 1 AND year(o_orderdate) < 2000 THEN o_orderdate + INTERVAL 100 YEAR ELSE o_orderdate END, '%Y-%m-%d') END
      AS parsed FROM orders""",
)
def f03(spark, d):
    case = F.col("o_orderkey") % 7
    formats = ("dd MMM yyyy", "dd MMM yy", "d MMM", "MMM dd", "dd/MM/yyyy", "dd/MM")
    text = F.upper(F.date_format(_day(), "dd MMM yy"))
    for i, pattern in reversed(list(enumerate(formats))):
        text = F.when(case == i, F.date_format(_day(), pattern)).otherwise(text)
    return _orders(spark, d).select("o_orderkey", S.parse_statement_date(text, F.year("o_orderdate")).alias("parsed"))


@query(
    "F04_parse_amount_lenient",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL
      ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS amount FROM orders""",
)
def f04(spark, d):
    text = (
        F.when(F.col("o_orderkey") % 11 == 0, " ")
        .when(F.col("o_orderkey") % 13 == 0, "12.x")
        .otherwise(F.concat(F.lit(" $"), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)))
    )
    return _orders(spark, d).select("o_orderkey", S.parse_amount_lenient(text).alias("amount"))


@query(
    "F05_parse_amount_strict",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 13 = 0 THEN NULL
      ELSE -CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS amount FROM orders""",
)
def f05(spark, d):
    text = (
        F.when(F.col("o_orderkey") % 11 == 0, " ")
        .when(F.col("o_orderkey") % 13 == 0, "12.x")
        .otherwise(F.concat(F.lit("- $"), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)))
    )
    return _orders(spark, d).select("o_orderkey", S.parse_amount_strict(text).alias("amount"))


@query(
    "F06_parse_money_tokens",
    """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount, o_orderkey % 3 <> 2 AS is_credit,
      concat('ITEM ', CAST(o_orderkey AS VARCHAR)) AS rest FROM orders""",
)
def f06(spark, d):
    money = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    tail = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("$"), money, F.lit(" CR")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("-$"), money))
        .otherwise(F.concat(money, F.lit(" dr ")))
    )
    text = F.concat(F.lit("ITEM "), F.col("o_orderkey").cast("string"), F.lit("  "), tail)
    return _orders(spark, d).select("o_orderkey", S.parse_money_token(text).alias("m")).select("o_orderkey", "m.*")


@query(
    "F07_collapse_ws",
    r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents",
)
def f07(spark, d):
    return M.table(spark, d, "documents").select("doc_id", F.md5(S.collapse_ws("text")).alias("digest"))


@query(
    "F08_upper_contains",
    f"""WITH {Q.RAW} SELECT txn_id, contains(upper(description), 'STORE 4') AS has_text,
      regexp_matches(upper(description), '(?i)^urgent .*store [13]') AS has_pattern FROM raw""",
)
def f08(spark, d):
    from tallyloom.operators.rules import matches

    return M.raw(spark, d).select(
        "txn_id",
        S.upper_contains("description", "store 4").alias("has_text"),
        matches(F.upper("description"), "^urgent .*store [13]").alias("has_pattern"),
    )


@query(
    "F09_financial_year",
    """WITH f AS (SELECT o_orderkey, CAST(year(o_orderdate + INTERVAL 6 MONTH) AS BIGINT) AS fy FROM orders)
    SELECT o_orderkey, fy, concat('FY ', CAST(fy - 1 AS VARCHAR), '-', substr(CAST(fy AS VARCHAR), 3)) AS label,
      concat(CAST(fy - 1 AS VARCHAR), '-07-01') AS first_day, concat(CAST(fy AS VARCHAR), '-06-30') AS last_day FROM f""",
)
def f09(spark, d):
    rows = _orders(spark, d).select("o_orderkey", S.fy_of(_day()).alias("fy"))
    first, last = S.fy_bounds("fy")
    return rows.select("o_orderkey", "fy", S.fy_label("fy").alias("label"), first.alias("first_day"), last.alias("last_day"))


@query(
    "F10_default_fy",
    """SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS BIGINT) AS fy FROM orders""",
)
def f10(spark, d):
    return _orders(spark, d).select("o_orderkey", S.default_fy(_day()).alias("fy"))


@query(
    "F11_period_keys",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y') AS year FROM orders""",
)
def f11(spark, d):
    return _orders(spark, d).select("o_orderkey", S.month_key(_day()).alias("month"), S.year_key(_day()).alias("year"))


@query(
    "F12_numeric",
    f"""WITH {Q.RAW} SELECT txn_id, {Q.money('abs(amount)', 'magnitude')}, {Q.money('round(amount * 0.333::DECIMAL(4,3), 2)', 'third')},
      COALESCE(CASE WHEN is_foreign THEN 'USD' END, 'AUD') AS currency, CASE WHEN amount < 0 THEN 'out' ELSE 'in' END AS direction FROM raw""",
)
def f12(spark, d):
    return M.raw(spark, d).select(
        "txn_id",
        F.abs("amount").alias("magnitude"),
        F.round(F.col("amount") * F.lit("0.333").cast("decimal(4,3)"), 2).alias("third"),
        F.coalesce("original_currency", F.lit("AUD")).alias("currency"),
        F.when(F.col("amount") < 0, "out").otherwise("in").alias("direction"),
    )


MONEY_TEXT = r"regexp_replace(CAST(amount AS VARCHAR), '0$', '')"


@query(
    "F13_dedup_hash",
    f"""WITH {Q.RAW}, r AS (SELECT *, CASE WHEN source_type = 'paypal' THEN concat('REF', CAST(txn_id AS VARCHAR))
      WHEN txn_id % 10 = 0 THEN concat('basiq:', CAST(txn_id AS VARCHAR)) END AS ref FROM raw)
    SELECT txn_id, sha256(CASE WHEN ref IS NOT NULL THEN ref
      WHEN source_type = 'ing' THEN concat(strftime(txn_date, '%Y-%m-%d'), '|', description, '|', {MONEY_TEXT}, '|', source_type, '_', CAST(account_id AS VARCHAR))
      ELSE concat(strftime(txn_date, '%Y-%m-%d'), '|', description, '|', {MONEY_TEXT}) END) AS dedup_hash FROM r""",
)
def f13(spark, d):
    key = F.col("txn_id").cast("string")
    reference = F.when(F.col("source_type") == "paypal", F.concat(F.lit("REF"), key)).when(
        F.col("txn_id") % 10 == 0, F.concat(F.lit("basiq:"), key)
    )
    rows = M.raw(spark, d).withColumn("reference_id", reference)
    return rows.select("txn_id", S.dedup_hash().alias("dedup_hash"))


@query(
    "F14_file_stem",
    f"WITH {Q.RAW} SELECT txn_id, concat(source_type, '_', CAST(account_id AS VARCHAR)) AS stem FROM raw",
)
def f14(spark, d):
    return M.raw(spark, d).select("txn_id", S.file_stem("source_file").alias("stem"))


@query(
    "F15_recorded_balance",
    f"""WITH {Q.RAW},
    rec AS (SELECT *,
      CASE WHEN txn_id % 4 = 0 THEN CAST(amount AS VARCHAR) WHEN txn_id % 4 = 1 THEN '0.00' ELSE '' END AS b1,
      CASE WHEN txn_id % 8 = 1 THEN 'n/a' WHEN txn_id % 3 = 0 THEN CAST(amount AS VARCHAR) END AS b2,
      CASE WHEN txn_id % 5 = 0 THEN '0' WHEN txn_id % 5 = 1 THEN CAST(amount AS VARCHAR) END AS b3 FROM raw),
    val AS (SELECT *, CASE
      WHEN b1 <> '' AND TRY_CAST(b1 AS DECIMAL(18,2)) <> 0 THEN TRY_CAST(b1 AS DECIMAL(18,2))
      WHEN b2 IS NOT NULL AND TRY_CAST(b2 AS DECIMAL(18,2)) IS NULL THEN NULL
      WHEN b2 IS NOT NULL AND TRY_CAST(b2 AS DECIMAL(18,2)) <> 0 THEN TRY_CAST(b2 AS DECIMAL(18,2))
      ELSE TRY_CAST(b3 AS DECIMAL(18,2)) END AS v FROM rec)
    SELECT txn_id, {Q.money("CASE WHEN account_type IN ('credit', 'loan') AND v > 0 THEN -v ELSE v END", 'balance')} FROM val""",
)
def f15(spark, d):
    rows = M.with_recorded_raw(M.raw(spark, d))
    return rows.select("txn_id", S.recorded_balance("raw", "account_type").alias("balance"))


@query("F16_merchant_key", f"WITH {Q.RAW} SELECT txn_id, upper(substr(description, 1, 40)) AS merchant FROM raw")
def f16(spark, d):
    return M.raw(spark, d).select("txn_id", S.merchant_key("description").alias("merchant"))


@query(
    "F17_unconverted_fx",
    f"WITH {Q.FX} SELECT txn_id, is_foreign AND txn_id % 2 = 0 AS unconverted FROM fx_raw",
)
def f17(spark, d):
    rows = M.raw(spark, d)
    foreign = F.when(F.col("original_currency").isNotNull() & (F.col("txn_id") % 2 == 0), -F.col("amount")).otherwise(
        F.col("original_amount")
    )
    flag = S.unconverted_fx(F.col("amount"), foreign, F.col("original_currency"))
    return rows.select("txn_id", flag.alias("unconverted"))


@query(
    "F18_fx_rate",
    f"""WITH {Q.FX} SELECT txn_id, round(abs(CAST(amount AS DOUBLE)) / abs(CAST(original_amount AS DOUBLE)), 6) AS rate FROM fx_raw""",
)
def f18(spark, d):
    rate = S.fx_rate("amount", "original_amount", "original_currency")
    return M.raw(spark, d).select("txn_id", rate.alias("rate"))


@query(
    "F19_sign_split",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)
        WHEN o_orderkey % 3 = 1 THEN -CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS credit_first,
      CASE WHEN o_orderkey % 3 = 2 THEN NULL WHEN o_orderkey % 3 = 0 THEN -7.0 ELSE -CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS debit_first
    FROM orders""",
)
def f19(spark, d):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    case = F.col("o_orderkey") % 3
    credit = F.when(case == 0, price).otherwise(F.lit(0))
    debit = F.when(case == 1, price).when(case == 0, F.lit(7)).otherwise(F.lit(0))
    return _orders(spark, d).select(
        "o_orderkey",
        S.sign_split(credit, debit).alias("credit_first"),
        S.sign_split(credit, debit, credit_first=False).alias("debit_first"),
    )
