"""Filters, joins, aggregates, top lists, rules and composed reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import predicates as P
from tallyloom.operators import accounts as ACC
from tallyloom.operators import holdings as H
from tallyloom.operators import rules as RULES
from tallyloom.operators import splits as SP
from tallyloom.plans import budget, dims, networth, summaries, tax, year_review
from workload import model as M
from workload import sqlmodel as Q
from workload.registry import query

FY_RANGE = "txn_date BETWEEN DATE '1997-07-01' AND DATE '1998-06-30'"
YEAR_RANGE = "txn_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"
KEPT = "NOT is_transfer AND account_type <> 'loan'"
POS = "SUM(CASE WHEN amount > 0 THEN amount ELSE 0 END)"
NEG = "SUM(CASE WHEN amount < 0 THEN amount ELSE 0 END)"
INCOME_NAMES = "('Airbnb Income', 'Salary')"
IS_INCOME = f"category IN {INCOME_NAMES} AS is_income"
CATEGORIES = M.SETTINGS.categories


def _list(where: str) -> str:
    return f"""WITH {Q.TXN} SELECT txn_id, {Q.day('txn_date', 'txn_date')}, description, {Q.money('amount', 'amount')},
      category, account_name FROM txn WHERE {where}"""


LIST = ("txn_id", "txn_date", "description", "amount", "category", "account_name")

# --- filters ---------------------------------------------------------------------------------------------------------


@query("P01_date_range", _list("txn_date BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'"))
def p01(spark, d):
    return P.date_range(M.txns(spark, d), "1997-03-01", "1998-02-28").select(*LIST)


@query("P02_category_account", _list("category = 'Groceries' AND account_name = 'Customer#000000008'"))
def p02(spark, d):
    return M.txns(spark, d).where(P.category_is("Groceries") & P.account_is("Customer#000000008")).select(*LIST)


@query("P03_text_search", _list("description ILIKE '%furniture_store 1%'"))
def p03(spark, d):
    return M.txns(spark, d).where(P.search("furniture_store 1")).select(*LIST)


@query("P04_exclude_loans", _list("account_type NOT IN ('loan')"))
def p04(spark, d):
    return M.txns(spark, d).where(P.not_loan()).select(*LIST)


@query("P05_exclude_transfers", _list("NOT is_transfer"))
def p05(spark, d):
    return M.txns(spark, d).where(P.not_transfer()).select(*LIST)


@query(
    "P06_sign_filter",
    f"""WITH {Q.TXN} SELECT CASE WHEN amount > 0 THEN 'income' ELSE 'expense' END AS kind, COUNT(*) AS n,
      {Q.money('SUM(amount)', 'total')} FROM txn WHERE amount <> 0 GROUP BY 1""",
)
def p06(spark, d):
    rows = M.txns(spark, d).where(P.income() | P.expense())
    kind = F.when(P.income(), "income").otherwise("expense")
    return rows.groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), summaries.money_sum().alias("total")
    )


@query("P07_business_prefix", _list("category LIKE 'Business:%'"))
def p07(spark, d):
    return M.txns(spark, d).where(P.business_category()).select(*LIST)


@query("P08_visible_accounts", f"WITH {Q.ACCOUNTS} SELECT account_id, account_name FROM accounts WHERE display")
def p08(spark, d):
    return M.accounts(spark, d).where(P.visible()).select("account_id", "account_name")


@query(
    "P10_spending_categories",
    f"""WITH {Q.TXN} SELECT category, {Q.money('SUM(amount)', 'total')}, COUNT(*) AS count FROM txn WHERE {KEPT}
      AND category <> 'Uncategorized' GROUP BY 1 HAVING SUM(amount) < 0""",
)
def p10(spark, d):
    return (
        summaries.category_summary(M.txns(spark, d), CATEGORIES)
        .where(P.spending_rows())
        .select("category", "total", "count")
    )


# --- joins -----------------------------------------------------------------------------------------------------------


@query(
    "J01_dimension_join",
    f"""WITH {Q.TXN} SELECT a.account_type, t.category, t.category IN {INCOME_NAMES} AS is_income, COUNT(*) AS n,
      {Q.money('SUM(t.amount)', 'total')} FROM txn t JOIN accounts a ON a.account_id = t.account_id GROUP BY 1, 2, 3""",
)
def j01(spark, d):
    txns = M.txns(spark, d).drop("account_name", "account_type")
    joined = ACC.with_accounts(txns, M.accounts(spark, d))
    named = joined.join(dims.categories_frame(spark, CATEGORIES), "category", "left")
    return named.groupBy("account_type", "category", "is_income").agg(
        F.count(F.lit(1)).alias("n"), summaries.money_sum().alias("total")
    )


@query(
    "J02_tag_semi_join",
    f"WITH {Q.TXN} SELECT txn_id, {Q.money('amount', 'amount')} FROM txn WHERE list_contains(tags, 'water')",
)
def j02(spark, d):
    return M.txns(spark, d).where(F.array_contains("tags", "water")).select("txn_id", "amount")


@query(
    "J03_tags_array",
    f"""WITH {Q.TXN} SELECT txn_id, array_to_string(list_sort(tags), ',') AS tags FROM txn""",
)
def j03(spark, d):
    txns = M.txns(spark, d)
    bridge = txns.select("txn_id", F.explode("tags").alias("tag"))
    grouped = bridge.groupBy("txn_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    empty = F.array().cast("array<string>")
    return txns.select("txn_id").join(grouped, "txn_id", "left").withColumn("tags", F.coalesce("tags", empty))


FIRST_SPLIT = """SELECT t.txn_id, CAST(t.amount AS DOUBLE) AS amount, COALESCE(s.business, '') AS biz_name,
      CAST(COALESCE(s.business_pct, 0) AS DOUBLE) AS biz_pct, CAST(COALESCE(s.business_amount, 0) AS DOUBLE) AS biz_amount,
      COALESCE(n.n, 0) AS n_splits
    FROM txn t
    LEFT JOIN (SELECT txn_id, arg_min(business, business_ord) AS business, arg_min(business_pct, business_ord) AS business_pct,
      arg_min(business_amount, business_ord) AS business_amount FROM splits GROUP BY 1) s ON s.txn_id = t.txn_id
    LEFT JOIN (SELECT txn_id, COUNT(*) AS n FROM splits GROUP BY 1) n ON n.txn_id = t.txn_id"""


@query("J04_splits_attached", f"WITH {Q.SPLITS} {FIRST_SPLIT}")
def j04(spark, d):
    txns = M.txns(spark, d)
    rows = SP.with_splits(txns, SP.compute_splits(txns, M.TAX))
    return rows.select("txn_id", "amount", "biz_name", "biz_pct", "biz_amount", F.size("splits").alias("n_splits"))


@query(
    "J05_splits_by_fy",
    f"""WITH {Q.SPLITS} SELECT t.fy, s.business, {Q.money('SUM(s.business_amount)', 'total')}, COUNT(*) AS n
      FROM splits s JOIN txn t ON t.txn_id = s.txn_id GROUP BY 1, 2""",
)
def j05(spark, d):
    txns = M.txns(spark, d)
    splits = SP.compute_splits(txns, M.TAX).select("txn_id", "business", "business_amount")
    from tallyloom.functions.scalars import fy_of

    dated = splits.join(txns.select("txn_id", fy_of("txn_date").alias("fy")), "txn_id")
    return dated.groupBy("fy", "business").agg(
        summaries.money_sum("business_amount").alias("total"), F.count(F.lit(1)).alias("n")
    )


BALANCES = f"""{Q.RAW},
rec AS (SELECT *,
    CASE WHEN txn_id % 4 = 0 THEN CAST(amount AS VARCHAR) WHEN txn_id % 4 = 1 THEN '0.00' ELSE '' END AS b1,
    CASE WHEN txn_id % 8 = 1 THEN 'n/a' WHEN txn_id % 3 = 0 THEN CAST(amount AS VARCHAR) END AS b2,
    CASE WHEN txn_id % 5 = 0 THEN '0' WHEN txn_id % 5 = 1 THEN CAST(amount AS VARCHAR) END AS b3 FROM raw),
val AS (SELECT *, CASE
    WHEN b1 <> '' AND TRY_CAST(b1 AS DECIMAL(18,2)) <> 0 THEN TRY_CAST(b1 AS DECIMAL(18,2))
    WHEN b2 IS NOT NULL AND TRY_CAST(b2 AS DECIMAL(18,2)) IS NULL THEN NULL
    WHEN b2 IS NOT NULL AND TRY_CAST(b2 AS DECIMAL(18,2)) <> 0 THEN TRY_CAST(b2 AS DECIMAL(18,2))
    ELSE TRY_CAST(b3 AS DECIMAL(18,2)) END AS v FROM rec),
newest AS (SELECT account_id, v FROM val QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY txn_date DESC, txn_id DESC) = 1),
sums AS (SELECT account_id, COUNT(*) AS n, SUM(amount) AS s FROM raw GROUP BY 1),
balances AS (SELECT a.account_id, a.account_name, a.account_type, COALESCE(s.n, 0) AS transaction_count,
    COALESCE(CASE WHEN a.account_type IN ('credit', 'loan') AND v > 0 THEN -v ELSE v END, s.s, 0) AS balance
  FROM accounts a LEFT JOIN newest USING (account_id) LEFT JOIN sums s USING (account_id) WHERE display)"""


def _balances(spark, d):
    return ACC.latest_balance(M.with_recorded_raw(M.raw(spark, d)), M.accounts(spark, d))


@query(
    "J08_latest_balance",
    f"""WITH {BALANCES} SELECT account_id, account_type, transaction_count, {Q.money('balance', 'balance')} FROM balances""",
)
def j08(spark, d):
    return _balances(spark, d).select("account_id", "account_type", "transaction_count", "balance")


@query(
    "J09_prefix_match",
    """SELECT doc_id, CASE WHEN source LIKE 'w%' THEN 'web' WHEN source LIKE 'b%' THEN 'books' WHEN source LIKE 'c%'
      THEN 'code' ELSE 'other' END AS account FROM documents""",
)
def j09(spark, d):
    from tallyloom.config import Account

    rules = [Account("web", "x", file_prefix="w"), Account("books", "x", file_prefix="b"), Account("code", "x", file_prefix="c")]
    account = ACC.resolve_account(rules, {}, file_name="source", source_type=F.lit("other"))
    return M.table(spark, d, "documents").select("doc_id", account.alias("account"))


@query(
    "J10_budget_join",
    f"""WITH {Q.TXN}, actual AS (SELECT category, SUM(amount) AS total FROM txn WHERE {KEPT}
      AND txn_date BETWEEN DATE '1997-05-01' AND DATE '1997-05-31' GROUP BY 1),
    budgets AS (SELECT * FROM (VALUES ('Groceries', 600), ('Utilities', 300), ('Strata', 50)) b(category, budget))
    SELECT category, {Q.money('budget', 'budget')}, {Q.money('abs(COALESCE(total, 0))', 'actual')} FROM budgets LEFT JOIN actual USING (category)""",
)
def j10(spark, d):
    return budget.budget_vs_actual(M.txns(spark, d), CATEGORIES, "1997-05").select("category", "budget", "actual")


@query(
    "J11_expense_mapping",
    f"""WITH {Q.TXN}, map AS (SELECT * FROM (VALUES ('Harbour Unit', 'Body corporate fees', 'Groceries', NULL),
      ('Harbour Unit', 'Interest on loans', 'Utilities', NULL), ('Harbour Unit', 'Water charges', NULL, 'water'),
      ('Harbour Unit', 'Repairs and maintenance', 'Business: Software', NULL), ('Hill House', 'Phone', NULL, 'mobile'))
      m(property, label, category, tag))
    SELECT property, label, COUNT(txn_id) AS n, {Q.money('SUM(amount)', 'total')} FROM map m
      JOIN txn t ON (m.category = t.category OR list_contains(t.tags, m.tag)) AND NOT t.is_transfer GROUP BY 1, 2""",
)
def j11(spark, d):
    txns = M.txns(spark, d).where(P.not_transfer())
    mapping = dims.expense_map_frame(spark, M.TAX).withColumnRenamed("category", "map_category")
    keys = F.array_append(F.transform("tags", lambda t: F.concat(F.lit("tag:"), t)), F.concat(F.lit("category:"), "category"))
    wanted = F.when(F.col("map_category").isNotNull(), F.concat(F.lit("category:"), "map_category")).otherwise(
        F.concat(F.lit("tag:"), "tag")
    )
    # sums per key first: what is joined to the mapping is one row per category and tag
    per_key = txns.select(F.explode(keys).alias("key"), "amount").groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), summaries.money_sum().alias("total")
    )
    return mapping.withColumn("key", wanted).join(per_key, "key").select("property", "label", "n", "total")


# --- aggregates ------------------------------------------------------------------------------------------------------


@query(
    "A01_monthly_summary",
    f"""WITH {Q.TXN} SELECT strftime(txn_date, '%Y-%m') AS month, {Q.money(NEG, 'expenses')}, {Q.money(POS, 'income')}
      FROM txn WHERE {KEPT} GROUP BY 1""",
)
def a01(spark, d):
    return summaries.monthly_summary(M.txns(spark, d))


@query(
    "A02_category_summary",
    f"""WITH {Q.TXN} SELECT category, {IS_INCOME}, {Q.money('SUM(amount)', 'total')}, COUNT(*) AS count
      FROM txn WHERE {KEPT} AND txn_date >= DATE '1996-07-01' GROUP BY 1, 2""",
)
def a02(spark, d):
    return summaries.category_summary(M.txns(spark, d), CATEGORIES, start="1996-07-01")


@query(
    "A03_category_trend",
    f"""WITH {Q.TXN} SELECT strftime(txn_date, '%Y-%m') AS month, category, {Q.money('SUM(amount)', 'total')}
      FROM txn WHERE {KEPT} AND amount < 0 GROUP BY 1, 2""",
)
def a03(spark, d):
    return summaries.category_trend(M.txns(spark, d))


PIVOT = ", ".join(
    f"CAST(abs(SUM(CASE WHEN category = '{c.name}' THEN amount ELSE 0 END)) AS DOUBLE) AS \"{c.name}\"" for c in CATEGORIES
)
CONFIGURED = ", ".join(f"'{c.name}'" for c in CATEGORIES)
PIVOT += f", CAST(abs(SUM(CASE WHEN category NOT IN ({CONFIGURED}) THEN amount ELSE 0 END)) AS DOUBLE) AS \"Other categories\""


@query(
    "A03b_trend_pivot",
    f"WITH {Q.TXN} SELECT strftime(txn_date, '%Y-%m') AS month, {PIVOT} FROM txn WHERE {KEPT} AND amount < 0 GROUP BY 1",
)
def a03b(spark, d):
    return summaries.trend_pivot(summaries.category_trend(M.txns(spark, d)), CATEGORIES)


@query(
    "A04_budget_vs_actual",
    f"""WITH {Q.TXN}, actual AS (SELECT category, abs(SUM(amount)) AS a FROM txn WHERE {KEPT}
      AND txn_date BETWEEN DATE '1998-02-01' AND DATE '1998-02-28' GROUP BY 1),
    budgets AS (SELECT * FROM (VALUES ('Groceries', 600), ('Utilities', 300), ('Strata', 50)) b(category, budget))
    SELECT category, {Q.money('budget', 'budget')}, {Q.money('COALESCE(a, 0)', 'actual')},
      {Q.money('budget - COALESCE(a, 0)', 'remaining')}, FALSE AS is_income,
      least(CAST(COALESCE(a, 0) AS DOUBLE) / CAST(budget AS DOUBLE) * 100, 100.0) AS pct, budget - COALESCE(a, 0) < 0 AS over
    FROM budgets LEFT JOIN actual USING (category)""",
)
def a04(spark, d):
    return budget.budget_vs_actual(M.txns(spark, d), CATEGORIES, "1998-02")


@query(
    "A05_tag_summary",
    f"""WITH {Q.TXN} SELECT tag, COUNT(*) AS count, {Q.money('SUM(amount)', 'total')}
      FROM (SELECT unnest(tags) AS tag, amount FROM txn) GROUP BY 1""",
)
def a05(spark, d):
    return summaries.tag_summary(M.txns(spark, d))


@query(
    "A06_tax_category_summary",
    f"""WITH {Q.TXN} SELECT category, {IS_INCOME}, {Q.money('SUM(amount)', 'total')}, COUNT(*) AS count
      FROM txn WHERE {KEPT} AND {FY_RANGE} GROUP BY 1, 2""",
)
def a06(spark, d):
    return tax.tax_category_summary(M.txns(spark, d), CATEGORIES, M.FY)


MONTHS = f"""WITH {Q.TXN}, m AS (SELECT strftime(txn_date, '%Y-%m') AS month, {POS} AS income, {NEG} AS expenses
      FROM txn WHERE {KEPT} AND {YEAR_RANGE} GROUP BY 1),
    t AS (SELECT CAST(COALESCE(SUM(income), 0) AS DOUBLE) AS i, CAST(abs(COALESCE(SUM(expenses), 0)) AS DOUBLE) AS e,
      CAST(COALESCE(SUM(income) - abs(SUM(expenses)), 0) AS DOUBLE) AS net, COUNT(*) AS months FROM m)"""


@query(
    "A07_year_totals",
    f"""{MONTHS} SELECT i AS total_income, e AS total_expenses, net, CASE WHEN i > 0 THEN (i - e) / i * 100 ELSE 0 END AS savings_rate,
      e / greatest(months, 1) AS avg_monthly_expense, months FROM t""",
)
def a07(spark, d):
    return summaries.year_totals(M.txns(spark, d), None, M.YEAR)


@query(
    "A08_year_over_year",
    f"""WITH {Q.TXN}, s AS (SELECT
      CAST(SUM(CASE WHEN year(txn_date) = 1998 THEN CASE WHEN amount > 0 THEN amount ELSE 0 END END) AS DOUBLE) AS income,
      CAST(SUM(CASE WHEN year(txn_date) = 1998 THEN CASE WHEN amount < 0 THEN amount ELSE 0 END END) AS DOUBLE) AS expenses,
      CAST(SUM(CASE WHEN year(txn_date) = 1997 THEN CASE WHEN amount > 0 THEN amount ELSE 0 END END) AS DOUBLE) AS prev_income,
      CAST(SUM(CASE WHEN year(txn_date) = 1997 THEN CASE WHEN amount < 0 THEN amount ELSE 0 END END) AS DOUBLE) AS prev_expenses
      FROM txn WHERE {KEPT} AND year(txn_date) IN (1997, 1998))
    SELECT *, CASE WHEN prev_income > 0 THEN (COALESCE(income, 0) - prev_income) / prev_income * 100 ELSE 0 END AS income_change,
      CASE WHEN abs(prev_expenses) > 0 THEN (abs(COALESCE(expenses, 0)) - abs(prev_expenses)) / abs(prev_expenses) * 100 ELSE 0 END
      AS expense_change FROM s""",
)
def a08(spark, d):
    return summaries.year_over_year(M.txns(spark, d), None, M.YEAR)


def _merchants(where: str, n: int) -> str:
    return f"""WITH {Q.TXN} SELECT upper(substr(description, 1, 40)) AS merchant, MIN(description) AS description, COUNT(*) AS count,
      {Q.money('SUM(amount)', 'total')} FROM txn WHERE {KEPT} AND amount < 0 AND {where} GROUP BY 1 ORDER BY SUM(amount), 1 LIMIT {n}"""


@query("A09_top_merchants", _merchants("TRUE", 15))
def a09(spark, d):
    return summaries.top_merchants(M.txns(spark, d))


@query("A10_source_counts", f"WITH {Q.TXN} SELECT source_type, COUNT(*) AS count FROM txn WHERE {YEAR_RANGE} GROUP BY 1")
def a10(spark, d):
    return summaries.source_counts(M.txns(spark, d), M.YEAR)


@query(
    "A11_business_by_category",
    f"""WITH {Q.TXN} SELECT category, {Q.money('SUM(amount)', 'total')}, COUNT(*) AS count FROM txn
      WHERE category LIKE 'Business:%' AND NOT is_transfer AND {YEAR_RANGE} GROUP BY 1""",
)
def a11(spark, d):
    return summaries.business_by_category(M.txns(spark, d), M.YEAR)


@query(
    "A12_account_counts",
    f"""WITH {Q.TXN} SELECT a.account_id, a.account_name, COUNT(t.txn_id) AS transaction_count FROM accounts a
      LEFT JOIN txn t ON t.account_id = a.account_id WHERE a.display GROUP BY 1, 2""",
)
def a12(spark, d):
    counts = ACC.account_counts(M.txns(spark, d), M.accounts(spark, d))
    return counts.select("account_id", "account_name", "transaction_count")


@query(
    "A13_income_by_category_fy",
    f"""WITH {Q.TXN} SELECT category, {Q.money('SUM(amount)', 'total')}, COUNT(*) AS count FROM txn
      WHERE {KEPT} AND {FY_RANGE} AND category IN {INCOME_NAMES} GROUP BY 1""",
)
def a13(spark, d):
    return tax.income_by_category(M.txns(spark, d), CATEGORIES, M.FY)


@query(
    "A14_split_totals_fy",
    f"""WITH {Q.SPLITS} SELECT business, {Q.money('SUM(business_amount)', 'total')}, COUNT(*) AS count FROM splits
      WHERE {FY_RANGE} GROUP BY 1""",
)
def a14(spark, d):
    return tax.split_totals(SP.compute_splits(M.txns(spark, d), M.TAX, M.FY))


@query(
    "A15_category_share",
    f"""WITH {Q.TXN}, s AS (SELECT category, COUNT(*) AS count, CAST(abs(SUM(amount)) AS DOUBLE) AS spent FROM txn
      WHERE {KEPT} AND category <> 'Uncategorized' GROUP BY 1 HAVING SUM(amount) < 0)
    SELECT category, count, spent, spent / SUM(spent) OVER () * 100 AS pct, spent / 12 AS monthly_avg FROM s""",
)
def a15(spark, d):
    return summaries.category_share(summaries.category_summary(M.txns(spark, d), CATEGORIES), 12)


HOLDINGS = f"""{Q.EVENTS},
snap AS (SELECT * FROM log WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1),
folded AS (SELECT s.user_id, s.seq, SUM(CASE WHEN e.event_type = 'purchase' THEN 1 WHEN e.event_type = 'click' THEN -1 ELSE 0 END) AS du,
    SUM(CASE WHEN e.event_type = 'purchase' THEN e.value ELSE 0 END) AS dc,
    arg_max(e.value, e.seq) FILTER (e.event_type = 'view') AS v, arg_max(e.event_date, e.seq) FILTER (e.event_type = 'view') AS vd
  FROM snap s JOIN log e ON e.user_id = s.user_id AND e.seq > s.seq AND e.event_type <> 'signup' GROUP BY 1, 2),
holdings AS (SELECT s.user_id AS holding_id, CASE s.user_id % 6 WHEN 0 THEN 'property' WHEN 1 THEN 'vehicle' WHEN 2 THEN 'shares'
    WHEN 3 THEN 'super' WHEN 4 THEN 'crypto' ELSE 'boat' END AS asset_type, concat('H', CAST(s.user_id AS VARCHAR)) AS name,
    10 + COALESCE(du, 0) AS units, s.value + COALESCE(dc, 0) AS cost_basis,
    COALESCE(v, CASE WHEN s.user_id % 3 = 0 THEN s.value * 2 END) AS current_value, COALESCE(vd, s.event_date) AS as_at_date
  FROM snap s LEFT JOIN folded f ON f.user_id = s.user_id)"""


def _holdings(spark, d):
    return H.holding_state(M.holding_snapshots(spark, d), M.holding_events(spark, d))


@query(
    "A16_net_worth",
    f"""WITH {BALANCES}, {HOLDINGS},
    acc AS (SELECT account_type AS item, SUM(balance) AS amount FROM balances GROUP BY 1),
    ass AS (SELECT asset_type AS item, SUM(COALESCE(current_value, cost_basis, 0)) AS amount FROM holdings GROUP BY 1),
    lines AS (SELECT 'account' AS section, item, amount FROM acc UNION ALL
      SELECT 'asset', item, amount FROM ass WHERE item <> 'boat' UNION ALL
      SELECT 'total', CASE WHEN item IN ('loan', 'credit') THEN 'debt' ELSE 'cash' END, SUM(amount) FROM acc GROUP BY 2 UNION ALL
      SELECT 'total', 'holdings', SUM(amount) FROM ass UNION ALL
      SELECT 'total', 'net_worth', (SELECT SUM(amount) FROM acc) + (SELECT SUM(amount) FROM ass))
    SELECT section, item, {Q.money('amount', 'amount')} FROM lines""",
)
def a16(spark, d):
    return networth.net_worth(_balances(spark, d), _holdings(spark, d))


@query(
    "A17_incoming_by_category",
    f"""WITH {Q.TXN} SELECT category, COUNT(*) AS count, {Q.money('SUM(amount)', 'total')} FROM txn
      WHERE {KEPT} AND amount > 0 AND {FY_RANGE} GROUP BY 1""",
)
def a17(spark, d):
    return summaries.incoming_by_category(M.txns(spark, d), None, M.FY)


OUTGOING = f"""WITH {Q.SPLITS}, first AS ({FIRST_SPLIT})"""


@query(
    "A18_outgoing_totals",
    f"""{OUTGOING} SELECT COUNT(*) AS count, {Q.money('SUM(abs(t.amount))', 'total')},
      {Q.money('SUM(abs(CAST(f.biz_amount AS DECIMAL(18,2))))', 'biz_total')}
    FROM txn t JOIN first f ON f.txn_id = t.txn_id WHERE {KEPT} AND t.amount < 0 AND {FY_RANGE}""",
)
def a18(spark, d):
    return tax.outgoing_totals(tax.sheet_outgoing(M.txns(spark, d), None, M.TAX, M.FY))


@query(
    "A19_scalar_sum",
    f"""WITH {Q.TXN} SELECT {Q.money("COALESCE(SUM(amount), 0)", 'total')} FROM txn WHERE {KEPT} AND {FY_RANGE} AND category = 'Salary'""",
)
def a19(spark, d):
    rows = P.in_fy(M.txns(spark, d), M.FY)
    return summaries.amount_sum(rows, P.exclusions() & P.category_is("Salary"))


@query(
    "A21_coverage",
    f"""WITH {Q.TXN} SELECT COUNT(*) AS total, COUNT(*) FILTER (category <> 'Uncategorized') AS categorized,
      CAST(COUNT(*) FILTER (category <> 'Uncategorized') AS DOUBLE) / COUNT(*) * 100 AS categorized_pct,
      COUNT(*) FILTER (is_transfer) AS transfers FROM txn""",
)
def a21(spark, d):
    return summaries.coverage(M.txns(spark, d))


# --- newest, first, top ----------------------------------------------------------------------------------------------


@query(
    "W01_latest_per_account",
    f"""WITH {Q.RAW} SELECT account_id, txn_id, {Q.money('amount', 'amount')}, description FROM raw
      QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY txn_date DESC, txn_id DESC) = 1""",
)
def w01(spark, d):
    return ACC.latest_row(M.raw(spark, d), "txn_id", "amount", "description")


@query(
    "N01_newest",
    f"""WITH {Q.TXN} SELECT txn_id, {Q.day('txn_date', 'txn_date')}, {Q.money('amount', 'amount')}, category FROM txn
      WHERE {KEPT} ORDER BY txn.txn_date DESC, txn_id DESC LIMIT 200""",
)
def n01(spark, d):
    return summaries.transactions(M.txns(spark, d), limit=200).select("txn_id", "txn_date", "amount", "category")


@query(
    "N02_biggest",
    f"""WITH {Q.TXN}, t AS (SELECT * FROM txn WHERE NOT is_transfer AND {YEAR_RANGE}),
    e AS (SELECT 'expense' AS kind, * FROM t WHERE amount < 0 ORDER BY amount, txn_id LIMIT 5),
    i AS (SELECT 'income' AS kind, * FROM t WHERE amount > 0 ORDER BY amount DESC, txn_id LIMIT 5)
    SELECT kind, {Q.day('txn_date', 'txn_date')}, description, {Q.money('amount', 'amount')}, account_name
    FROM (SELECT * FROM e UNION ALL SELECT * FROM i)""",
)
def n02(spark, d):
    txns = M.txns(spark, d)
    expense = year_review.biggest(txns, None, M.YEAR, income=False).withColumn("kind", F.lit("expense"))
    return expense.unionByName(year_review.biggest(txns, None, M.YEAR, income=True).withColumn("kind", F.lit("income")))


@query(
    "N03_ordered_dims",
    f"""WITH {Q.ACCOUNTS} SELECT account_id, account_name, source_type, 'AUD' AS currency, account_type FROM accounts""",
)
def n03(spark, d):
    return dims.list_accounts(M.accounts(spark, d))


# --- rules -----------------------------------------------------------------------------------------------------------


@query("R01_mark_payments", f"WITH {Q.RAW} SELECT txn_id, {Q.PAYMENT} AS is_payment FROM raw")
def r01(spark, d):
    return M.raw(spark, d).select("txn_id", RULES.payment_expr(M.SETTINGS.accounts).alias("is_payment"))


@query(
    "R02_categorize",
    f"WITH {Q.TXN} SELECT txn_id, category, {Q.money('confidence', 'confidence')} FROM txn",
)
def r02(spark, d):
    return M.txns(spark, d).select("txn_id", "category", "confidence")


@query(
    "R02b_categorize_distinct_text",
    f"WITH {Q.TXN} SELECT txn_id, category, {Q.money('confidence', 'confidence')}, array_to_string(tags, ',') AS tags FROM txn",
)
def r02b(spark, d):
    rows = RULES.classify(M.raw(spark, d), M.SETTINGS, distinct_text=True)
    return rows.select("txn_id", "category", "confidence", "tags")


@query("R03_is_transfer", f"WITH {Q.TXN} SELECT txn_id, is_transfer FROM txn")
def r03(spark, d):
    return M.txns(spark, d).select("txn_id", "is_transfer")


@query("R04_tags", f"WITH {Q.TXN} SELECT txn_id, array_to_string(tags, ',') AS tags FROM txn")
def r04(spark, d):
    return M.txns(spark, d).select("txn_id", "tags")


@query(
    "R05_compute_splits",
    f"WITH {Q.SPLITS} SELECT txn_id, business, business_ord, {Q.money('business_pct', 'business_pct')} FROM splits",
)
def r05(spark, d):
    return SP.compute_splits(M.txns(spark, d), M.TAX).select("txn_id", "business", "business_ord", "business_pct")


@query(
    "R06_split_amount",
    f"WITH {Q.SPLITS} SELECT txn_id, business, {Q.money('business_amount', 'business_amount')} FROM splits",
)
def r06(spark, d):
    return SP.compute_splits(M.txns(spark, d), M.TAX).select("txn_id", "business", "business_amount")


# --- composed reports ------------------------------------------------------------------------------------------------


@query(
    "Q01_transactions",
    f"""WITH {Q.TXN} SELECT txn_id, {Q.day('txn_date', 'txn_date')}, description, {Q.money('amount', 'amount')}, category,
      {Q.money('confidence', 'confidence')}, account_name, account_type, source_type, is_transfer, array_to_string(tags, ',') AS tags
    FROM txn WHERE {KEPT} AND txn_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND description ILIKE '%store 4%'""",
)
def q01(spark, d):
    rows = summaries.transactions(M.txns(spark, d), start="1996-01-01", end="1999-12-31", search="store 4")
    return rows.select(
        "txn_id", "txn_date", "description", "amount", "category", "confidence", "account_name", "account_type",
        "source_type", "is_transfer", "tags",
    )


@query(
    "Q02_accounts_summary",
    f"""WITH {BALANCES}, {HOLDINGS}
    SELECT 'account' AS kind, account_type AS type, account_name AS name, transaction_count AS n, {Q.money('balance', 'amount')} FROM balances
    UNION ALL SELECT 'holding', asset_type, name, CAST(units AS BIGINT), CAST(COALESCE(current_value, cost_basis) AS DOUBLE) FROM holdings""",
)
def q02(spark, d):
    parts = networth.accounts_summary(
        M.with_recorded_raw(M.raw(spark, d)), M.accounts(spark, d), _holdings(spark, d)
    )
    accounts = parts["accounts"].select(
        F.lit("account").alias("kind"),
        F.col("account_type").alias("type"),
        F.col("account_name").alias("name"),
        F.col("transaction_count").alias("n"),
        F.col("balance").alias("amount"),
    )
    holdings = parts["holdings"].select(
        F.lit("holding").alias("kind"),
        F.col("asset_type").alias("type"),
        "name",
        F.col("units").cast("long").alias("n"),
        F.col("current_value").alias("amount"),
    )
    return accounts.unionByName(holdings)


@query(
    "Q03_tax_business_rows",
    f"""WITH {Q.TXN} SELECT {Q.day('txn_date', 'txn_date')}, description, {Q.money('amount', 'amount')}, category, account_name FROM txn
      WHERE category LIKE 'Business:%' AND NOT is_transfer AND {FY_RANGE}""",
)
def q03(spark, d):
    return tax.tax_summary(M.txns(spark, d), CATEGORIES, M.FY)["business_transactions"]


REVIEW = f"""WITH {Q.TXN}, y AS (SELECT * FROM txn WHERE {YEAR_RANGE}), k AS (SELECT * FROM y WHERE {KEPT}),
    p AS (SELECT * FROM txn WHERE {KEPT} AND txn_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'),
    mer AS (SELECT upper(substr(description, 1, 40)) AS item, COUNT(*) AS count, SUM(amount) AS amount FROM k WHERE amount < 0
      GROUP BY 1 ORDER BY 3, 1 LIMIT 20),
    be AS (SELECT * FROM y WHERE NOT is_transfer AND amount < 0 ORDER BY amount, txn_id LIMIT 5),
    bi AS (SELECT * FROM y WHERE NOT is_transfer AND amount > 0 ORDER BY amount DESC, txn_id LIMIT 5),
    lines AS (
      SELECT 'monthly_income' AS section, strftime(txn_date, '%Y-%m') AS item, COUNT(*) AS count, SUM(amount) AS amount FROM k WHERE amount > 0 GROUP BY 2
      UNION ALL SELECT 'monthly_expenses', strftime(txn_date, '%Y-%m'), COUNT(*), SUM(amount) FROM k WHERE amount < 0 GROUP BY 2
      UNION ALL SELECT 'category', category, COUNT(*), SUM(amount) FROM k GROUP BY 2
      UNION ALL SELECT 'business', category, COUNT(*), SUM(amount) FROM y WHERE category LIKE 'Business:%' AND NOT is_transfer GROUP BY 2
      UNION ALL SELECT 'source', source_type, COUNT(*), SUM(amount) FROM y GROUP BY 2
      UNION ALL SELECT 'previous_income', 'all', COUNT(*), SUM(amount) FROM p WHERE amount > 0 HAVING COUNT(*) > 0
      UNION ALL SELECT 'previous_expenses', 'all', COUNT(*), SUM(amount) FROM p WHERE amount < 0 HAVING COUNT(*) > 0
      UNION ALL SELECT 'income', 'all', COUNT(*), SUM(amount) FROM k WHERE amount > 0 HAVING COUNT(*) > 0
      UNION ALL SELECT 'expenses', 'all', COUNT(*), SUM(amount) FROM k WHERE amount < 0 HAVING COUNT(*) > 0
      UNION ALL SELECT 'merchant', item, count, amount FROM mer
      UNION ALL SELECT 'biggest_expense', concat(strftime(txn_date, '%Y-%m-%d'), ' ', account_name), 1, amount FROM be
      UNION ALL SELECT 'biggest_income', concat(strftime(txn_date, '%Y-%m-%d'), ' ', account_name), 1, amount FROM bi)
    SELECT section, item, count, {Q.money('amount', 'amount')} FROM lines"""


@query("Q04_year_review", REVIEW)
def q04(spark, d):
    return year_review.year_review_lines(M.txns(spark, d), None, M.YEAR)


SHEET_SQL = f"""t.txn_id, {Q.day('t.txn_date', 'txn_date')}, t.description, CAST(t.amount AS DOUBLE) AS amount, t.source_type, t.category, t.account_name"""


@query(
    "Q05_sheet_outgoing",
    f"""{OUTGOING} SELECT {SHEET_SQL}, f.biz_name, f.biz_pct, f.biz_amount, f.n_splits FROM txn t JOIN first f ON f.txn_id = t.txn_id
      WHERE {KEPT} AND t.amount < 0 AND {FY_RANGE}""",
)
def q05(spark, d):
    sheet = tax.sheet_outgoing(M.txns(spark, d), None, M.TAX, M.FY)
    return sheet.withColumn("n_splits", F.size("splits")).drop("splits")


@query("Q06_sheet_incoming", f"WITH {Q.TXN} SELECT {SHEET_SQL} FROM txn t WHERE {KEPT} AND t.amount > 0 AND {FY_RANGE}")
def q06(spark, d):
    return tax.sheet_incoming(M.txns(spark, d), None, M.FY)


FACTS = f"""{Q.SPLITS}, f AS (SELECT * FROM txn WHERE NOT is_transfer AND {FY_RANGE}),
  s AS (SELECT COALESCE(SUM(CASE WHEN category = 'Airbnb Income' THEN amount END), 0)::DECIMAL(28,2) AS airbnb,
    COALESCE(SUM(CASE WHEN category = 'Salary' THEN amount END), 0)::DECIMAL(28,2) AS salary_all,
    COALESCE(SUM(CASE WHEN category = 'Salary' AND account_type <> 'loan' THEN amount END), 0)::DECIMAL(28,2) AS salary,
    abs(COALESCE(SUM(CASE WHEN category = 'Groceries' THEN amount END), 0))::DECIMAL(28,2) AS m1,
    abs(COALESCE(SUM(CASE WHEN category = 'Utilities' THEN amount END), 0))::DECIMAL(28,2) AS m2,
    abs(COALESCE(SUM(CASE WHEN list_contains(tags, 'water') THEN amount END), 0))::DECIMAL(28,2) AS m3,
    abs(COALESCE(SUM(CASE WHEN category = 'Business: Software' THEN amount END), 0))::DECIMAL(28,2) AS m4,
    abs(COALESCE(SUM(CASE WHEN list_contains(tags, 'mobile') THEN amount END), 0))::DECIMAL(28,2) AS m5,
    (SELECT COALESCE(SUM(business_amount), 0) FROM splits WHERE business = 'North Studio' AND {FY_RANGE})::DECIMAL(28,2) AS north,
    (SELECT COALESCE(SUM(business_amount), 0) FROM splits WHERE business = 'South Studio' AND {FY_RANGE})::DECIMAL(28,2) AS south
    FROM f),
  r AS (SELECT *, ROUND(airbnb * 0.5::DECIMAL(3,1), 2) AS i1, ROUND(m1 * 0.5::DECIMAL(3,1), 2) AS s1, ROUND(m2 * 0.5::DECIMAL(3,1), 2) AS s2,
    ROUND(m3 * 0.5::DECIMAL(3,1), 2) AS s3, ROUND(m4 * 0.5::DECIMAL(3,1), 2) AS s4,
    ROUND(salary_all * 0.333333::DECIMAL(7,6), 2) AS i2, ROUND(m5 * 0.333333::DECIMAL(7,6), 2) AS s5 FROM s)"""


def _select(rows: list[tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{s}' AS section, '{i}' AS item, '{n}' AS label, CAST({e} AS DOUBLE) AS amount FROM r" for s, i, n, e in rows
    )


RENTAL_LINES = [
    ("rental", "Harbour Unit", "rental_weeks", "20"),
    ("rental", "Harbour Unit", "gross_income", "airbnb"),
    ("rental", "Harbour Unit", "income_share", "i1"),
    ("rental", "Harbour Unit", "raw: Body corporate fees", "m1"),
    ("rental", "Harbour Unit", "share: Body corporate fees", "s1"),
    ("rental", "Harbour Unit", "raw: Interest on loans", "m2"),
    ("rental", "Harbour Unit", "share: Interest on loans", "s2"),
    ("rental", "Harbour Unit", "raw: Water charges", "m3"),
    ("rental", "Harbour Unit", "share: Water charges", "s3"),
    ("rental", "Harbour Unit", "raw: Repairs and maintenance", "m4"),
    ("rental", "Harbour Unit", "share: Repairs and maintenance", "s4"),
    ("rental", "Harbour Unit", "depreciation: Capital allowances", "100"),
    ("rental", "Harbour Unit", "total_expenses", "s1 + s2 + s3 + s4 + 100"),
    ("rental", "Harbour Unit", "net_rent", "i1 - (s1 + s2 + s3 + s4 + 100)"),
    ("rental", "Hill House", "rental_weeks", "0"),
    ("rental", "Hill House", "gross_income", "salary_all"),
    ("rental", "Hill House", "income_share", "i2"),
    ("rental", "Hill House", "raw: Phone", "m5"),
    ("rental", "Hill House", "share: Phone", "s5"),
    ("rental", "Hill House", "total_expenses", "s5"),
    ("rental", "Hill House", "net_rent", "i2 - s5"),
]
BUSINESS_LINES = [
    ("business", "North Studio", "income", "0"),
    ("business", "North Studio", "expenses", "north"),
    ("business", "North Studio", "depreciation", "500"),
    ("business", "North Studio", "net", "north - 500"),
    ("business", "South Studio", "income", "0"),
    ("business", "South Studio", "expenses", "south"),
    ("business", "South Studio", "depreciation", "0"),
    ("business", "South Studio", "net", "south"),
]
OTHER_LINES = [
    ("income", "", "salary", "salary"),
    ("income", "", "interest", "0"),
    ("income", "", "tax_withheld", "51000"),
    ("deduction", "wfh", "weeks", "48"),
    ("deduction", "wfh", "allocation_pct", "100"),
    ("deduction", "wfh", "amount", "1222.08"),
    ("manual", "income", "Tax withheld", "50000"),
    ("manual", "deduction", "Union fees", "310.20"),
    ("manual", "income", "Tax withheld", "51000"),
    ("spouse", "B Holder", "taxable_income", "90000"),
]


@query("Q07_rental_schedule", f"WITH {FACTS} {_select(RENTAL_LINES)}")
def q07(spark, d):
    return tax.rental_schedule(M.txns(spark, d), M.TAX, M.FY)


@query("Q08_business_schedule", f"WITH {FACTS} {_select(BUSINESS_LINES)}")
def q08(spark, d):
    txns = M.txns(spark, d)
    return tax.business_schedule(txns, M.TAX, M.FY, SP.compute_splits(txns, M.TAX))


@query(
    "Q09_wfh",
    """SELECT c_custkey AS holder, CAST(c_custkey % 53 AS BIGINT) AS weeks,
      CAST(ROUND(CAST(c_custkey % 53 AS DECIMAL(7,2)) * CAST(c_custkey % 101 AS DECIMAL(7,4)) * 0.01::DECIMAL(3,2) * 38::DECIMAL(4,0), 1) AS DOUBLE) AS hours,
      CAST(ROUND(CAST(c_custkey % 53 AS DECIMAL(7,2)) * CAST(c_custkey % 101 AS DECIMAL(7,4)) * 0.01::DECIMAL(3,2) * 38::DECIMAL(4,0) * 0.67::DECIMAL(3,2), 2) AS DOUBLE) AS amount
    FROM customer""",
)
def q09(spark, d):
    key = F.col("c_custkey")
    entries = M.table(spark, d, "customer").select(
        key.alias("holder"),
        (key % 53).alias("weeks"),
        (key % 101).alias("allocation_pct"),
        F.lit("0.67").cast("decimal(3,2)").alias("rate_per_hour"),
    )
    return tax.wfh(entries).select("holder", "weeks", "hours", "amount")


@query("Q11_tax_return", f"WITH {FACTS} {_select(OTHER_LINES + RENTAL_LINES + BUSINESS_LINES)}")
def q11(spark, d):
    return tax.tax_return(M.txns(spark, d), M.TAX, M.FY)


@query(
    "Q12_tax_lines",
    f"""WITH {Q.SPLITS}
    SELECT 'income' AS section, category AS item, COUNT(*) AS count, {Q.money('SUM(amount)', 'amount')} FROM txn
      WHERE {KEPT} AND {FY_RANGE} AND category IN {INCOME_NAMES} GROUP BY 2
    UNION ALL SELECT 'business', business, COUNT(*), CAST(SUM(business_amount) AS DOUBLE) FROM splits WHERE {FY_RANGE} GROUP BY 2
    UNION ALL SELECT * FROM (VALUES ('depreciation', 'Capital allowances', 1, 100.0::DOUBLE), ('depreciation', 'Laptop', 1, 500.0::DOUBLE),
      ('manual', 'Tax withheld', 1, 50000.0::DOUBLE), ('manual', 'Union fees', 1, 310.2::DOUBLE), ('manual', 'Tax withheld', 1, 51000.0::DOUBLE)) v""",
)
def q12(spark, d):
    return tax.tax_lines(M.txns(spark, d), CATEGORIES, M.TAX, M.FY)


@query(
    "Q13_dashboard_cards",
    f"""{MONTHS} SELECT i AS total_income, e AS total_expenses, net, CASE WHEN i > 0 THEN (i - e) / i * 100 ELSE 0 END AS savings_rate,
      e / greatest(months, 1) AS avg_monthly_expense FROM t""",
)
def q13(spark, d):
    monthly = summaries.monthly_summary(M.txns(spark, d), year=M.YEAR)
    return summaries.totals(monthly).drop("months")


@query(
    "Q14_holdings_list",
    f"""WITH {HOLDINGS} SELECT asset_type, name, {Q.money('units', 'units')}, {Q.money('cost_basis', 'cost_basis')},
      {Q.money('current_value', 'current_value')}, {Q.day('as_at_date', 'as_at_date')} FROM holdings""",
)
def q14(spark, d):
    rows = dims.list_holdings(_holdings(spark, d))
    return rows.select("asset_type", "name", "units", "cost_basis", "current_value", "as_at_date")


@query(
    "Q15_depreciation_by_fy",
    """SELECT CAST(year(l_shipdate + INTERVAL 6 MONTH) AS BIGINT) AS fy, CASE WHEN l_linenumber % 2 = 0 THEN 'rental' ELSE 'business' END AS kind,
      CAST(l_suppkey AS VARCHAR) AS owner, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, COUNT(*) AS items
    FROM lineitem GROUP BY 1, 2, 3""",
)
def q15(spark, d):
    from tallyloom.functions.scalars import fy_of

    items = M.table(spark, d, "lineitem").select(
        fy_of(F.col("l_shipdate").cast("date")).alias("fy"),
        F.when(F.col("l_linenumber") % 2 == 0, "rental").otherwise("business").alias("kind"),
        F.col("l_suppkey").cast("string").alias("owner"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
    )
    return tax.depreciation_by_fy(items)
