"""Edits, overrides, holdings, trips, tags and splits as folds over logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import edits as E
from tallyloom.operators import holdings as H
from tallyloom.operators import rules as RULES
from tallyloom.operators import splits as SP
from tallyloom.plans import dims, tax
from tallyloom.sinks import store as ST
from workload import model as M
from workload import sqlmodel as Q
from workload.registry import query

KNOWN = M.SETTINGS.category_names

LATEST = f"""{Q.TXN}, {Q.EVENTS},
cat AS (SELECT txn_id, arg_max(new_category, seq) AS new_category, COUNT(*) AS n FROM log
  WHERE new_category IN ('Groceries', 'Utilities', 'Salary') GROUP BY 1),
note AS (SELECT txn_id, new_notes FROM log WHERE has_notes QUALIFY row_number() OVER (PARTITION BY txn_id ORDER BY seq DESC) = 1)"""


@query(
    "E01_recategorise",
    f"""WITH {LATEST} SELECT t.txn_id, COALESCE(c.new_category, t.category) AS category,
      CAST(CASE WHEN c.new_category IS NOT NULL THEN 1.0 ELSE t.confidence END AS DOUBLE) AS confidence, t.is_transfer
    FROM txn t LEFT JOIN cat c ON c.txn_id = t.txn_id""",
)
def e01(spark, d):
    rows = E.apply_edits(M.txns(spark, d), M.edit_log(spark, d), KNOWN)
    return rows.select("txn_id", "category", "confidence", "is_transfer")


LEARNED = f"""{LATEST}, learned AS (SELECT upper(t.description) AS pattern, arg_max(l.new_category, l.seq) AS category, COUNT(*) AS times_seen
  FROM log l JOIN txn t ON t.txn_id = l.txn_id WHERE l.new_category IN ('Groceries', 'Utilities', 'Salary') GROUP BY 1)"""


@query("E02_learned_rules", f"WITH {LEARNED} SELECT pattern, category, times_seen FROM learned")
def e02(spark, d):
    return E.learned_rules(M.edit_log(spark, d), M.raw(spark, d), KNOWN)


@query(
    "J07_learned_lookup",
    f"""WITH {LEARNED} SELECT r.txn_id, {Q.category_case('l.category')} AS category,
      CAST(CASE WHEN {Q.category_case()} = 'Uncategorized' AND l.category IS NOT NULL THEN 0.7 ELSE {Q.CONFIDENCE} END AS DOUBLE) AS confidence
    FROM raw r LEFT JOIN learned l ON l.pattern = upper(r.description)""",
)
def j07(spark, d):
    learned = E.learned_rules(M.edit_log(spark, d), M.raw(spark, d), KNOWN)
    return M.txns(spark, d, learned).select("txn_id", "category", "confidence")


@query(
    "E03_notes",
    f"WITH {LATEST} SELECT t.txn_id, n.new_notes AS notes FROM txn t LEFT JOIN note n ON n.txn_id = t.txn_id",
)
def e03(spark, d):
    return E.apply_edits(M.txns(spark, d), M.edit_log(spark, d), KNOWN).select("txn_id", "notes")


OVERRIDES = f"""{Q.SPLITS}, {Q.EVENTS},
o AS (SELECT txn_id, seq, CASE user_id % 3 WHEN 0 THEN 'North Studio' WHEN 1 THEN 'South Studio' ELSE 'North Studio' END AS business,
    CAST(CASE WHEN user_id % 4 = 0 THEN 0 ELSE user_id % 90 END AS DECIMAL(7,4)) AS pct FROM log),
last AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY txn_id, business ORDER BY seq DESC) = 1)"""


def _override_log(spark, d):
    user = F.col("user_id")
    business = F.when(user % 3 == 0, "North Studio").when(user % 3 == 1, "South Studio")
    pct = F.when(user % 4 != 0, user % 90)
    return M.edit_log(spark, d).select("txn_id", "seq", business.alias("business"), pct.alias("business_pct"))


@query(
    "E04_split_overrides",
    f"""WITH {OVERRIDES} SELECT s.txn_id, s.business, {Q.money('s.business_pct', 'business_pct')}, {Q.money('s.business_amount', 'business_amount')}
      FROM splits s WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.txn_id = s.txn_id AND l.business = s.business)
    UNION ALL SELECT l.txn_id, l.business, CAST(l.pct AS DOUBLE), CAST(ROUND(t.amount * l.pct * 0.01::DECIMAL(3,2), 2) AS DOUBLE)
      FROM last l JOIN txn t ON t.txn_id = l.txn_id WHERE l.pct <> 0""",
)
def e04(spark, d):
    txns = M.txns(spark, d)
    out = E.apply_split_overrides(SP.compute_splits(txns, M.TAX), _override_log(spark, d), txns, M.TAX)
    return out.select("txn_id", "business", "business_pct", "business_amount")


TAX_OVERRIDES = """ol AS (SELECT 1990 + user_id % 9 AS fy, CASE WHEN user_id % 2 = 0 THEN 'income' ELSE 'deduction' END AS section,
      concat('L', CAST(user_id % 31 AS VARCHAR)) AS label, seq, value AS amount, event_type = 'error' AS deleted FROM log),
    ov AS (SELECT * FROM (SELECT * FROM ol QUALIFY row_number() OVER (PARTITION BY fy, section, label ORDER BY seq DESC) = 1) WHERE NOT deleted)"""


@query("E05_tax_overrides", f"WITH {Q.EVENTS}, {TAX_OVERRIDES} SELECT fy, section, label, {Q.money('amount', 'amount')} FROM ov")
def e05(spark, d):
    return _tax_overrides(spark, d).select("fy", "section", "label", "amount")


def _tax_overrides(spark, d):
    user = F.col("user_id")
    log = M.edit_log(spark, d).select(
        (user % 9 + 1990).alias("fy"),
        F.when(user % 2 == 0, "income").otherwise("deduction").alias("section"),
        F.concat(F.lit("L"), (user % 31).cast("string")).alias("label"),
        "seq",
        F.col("value").alias("amount"),
        (F.col("event_type") == "error").alias("deleted"),
    )
    return E.tax_overrides(log)


TRIP_TABLES = """tl AS (SELECT 1990 + user_id % 9 AS fy, concat('Trip ', CAST(user_id AS VARCHAR)) AS name, seq AS trip_id, seq,
      event_date AS start_date, event_type = 'error' AS deleted FROM log WHERE event_type IN ('signup', 'error')),
    trips AS (SELECT * FROM (SELECT * FROM tl QUALIFY row_number() OVER (PARTITION BY fy, name ORDER BY seq DESC) = 1) WHERE NOT deleted),
    ex AS (SELECT l_orderkey % (SELECT count(*) FROM events) AS trip_id, CASE l_linenumber % 3 WHEN 0 THEN 'flights' WHEN 1 THEN 'meals' ELSE 'car' END
      AS expense_type, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem)"""
TRIPS = f"{Q.EVENTS}, {TRIP_TABLES}"


def _trips(spark, d):
    log = M.edit_log(spark, d).where(F.col("event_type").isin("signup", "error"))
    trips = log.select(
        (F.col("user_id") % 9 + 1990).alias("fy"),
        F.concat(F.lit("Trip "), F.col("user_id").cast("string")).alias("name"),
        F.col("seq").alias("trip_id"),
        "seq",
        F.col("event_date").alias("start_date"),
        (F.col("event_type") == "error").alias("deleted"),
    )
    events = M.table(spark, d, "events").agg(F.count(F.lit(1))).scalar()
    kind = F.col("l_linenumber") % 3
    expenses = M.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % events).alias("trip_id"),
        F.when(kind == 0, "flights").when(kind == 1, "meals").otherwise("car").alias("expense_type"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
    )
    return E.current_trips(trips, expenses)


@query(
    "E06_trip_cascade",
    f"""WITH {TRIPS} SELECT t.trip_id, t.name, COUNT(e.amount) AS expenses FROM trips t LEFT JOIN ex e ON e.trip_id = t.trip_id GROUP BY 1, 2""",
)
def e06(spark, d):
    trips, expenses = _trips(spark, d)
    counts = expenses.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"))
    out = trips.join(counts, "trip_id", "left")
    return out.select("trip_id", "name", F.coalesce("n", F.lit(0)).alias("expenses"))


@query(
    "J12_trip_expenses",
    f"""WITH {TRIPS}, s AS (SELECT trip_id, COALESCE(SUM(amount), 0) AS total, COALESCE(SUM(amount) FILTER (expense_type = 'flights'), 0) AS flights,
      COALESCE(SUM(amount) FILTER (expense_type = 'meals'), 0) AS meals FROM ex GROUP BY 1)
    SELECT t.trip_id, t.name, t.fy, CAST(COALESCE(total, 0) AS DOUBLE) AS total, CAST(COALESCE(flights, 0) AS DOUBLE) AS flights,
      CAST(COALESCE(meals, 0) AS DOUBLE) AS meals FROM trips t LEFT JOIN s ON s.trip_id = t.trip_id""",
)
def j12(spark, d):
    trips, expenses = _trips(spark, d)
    rows = tax.work_trips(trips, expenses)

    def part(kind: str):
        return F.coalesce(F.col("by_type")[kind], F.lit(0).cast("decimal(28,2)")).alias(kind)

    return rows.select("trip_id", "name", "fy", "total", part("flights"), part("meals"))


@query(
    "Q10_work_trips",
    f"""WITH {TRIPS}, s AS (SELECT trip_id, SUM(amount) AS total FROM ex GROUP BY 1)
    SELECT t.name, strftime(t.start_date, '%Y-%m-%d') AS start_date, CAST(COALESCE(total, 0) AS DOUBLE) AS total
    FROM trips t LEFT JOIN s ON s.trip_id = t.trip_id WHERE t.fy = 1994""",
)
def q10(spark, d):
    trips, expenses = _trips(spark, d)
    return tax.work_trips(trips, expenses, 1994).select("name", "start_date", "total")


def _shares(spark, d):
    """Splits table with the overrides of the log applied."""
    txns = M.txns(spark, d)
    return txns, E.apply_split_overrides(SP.compute_splits(txns, M.TAX), _override_log(spark, d), txns, M.TAX)


@query(
    "Q11b_tax_return_parts",
    f"""WITH {OVERRIDES}, {TAX_OVERRIDES}, {TRIP_TABLES},
    now AS (SELECT s.txn_id, s.business, s.business_amount FROM splits s WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.txn_id = s.txn_id AND l.business = s.business)
      UNION ALL SELECT l.txn_id, l.business, ROUND(t.amount * l.pct * 0.01::DECIMAL(3,2), 2) FROM last l JOIN txn t ON t.txn_id = l.txn_id WHERE l.pct <> 0),
    spent AS (SELECT business, SUM(business_amount) AS amount FROM now JOIN txn USING (txn_id) WHERE txn_date BETWEEN DATE '1997-07-01' AND DATE '1998-06-30' GROUP BY 1),
    tt AS (SELECT t.trip_id, t.name, e.expense_type, e.amount FROM trips t LEFT JOIN ex e ON e.trip_id = t.trip_id WHERE t.fy = {M.FY})
    SELECT 'business' AS section, business AS item, 'expenses' AS label, CAST(amount AS DOUBLE) AS amount FROM spent
    UNION ALL SELECT 'override', section, label, {Q.money('amount', 'amount')} FROM ov WHERE fy = {M.FY}
    UNION ALL SELECT 'work_trip', name, 'total', CAST(COALESCE(SUM(amount), 0) AS DOUBLE) FROM tt GROUP BY trip_id, name
    UNION ALL SELECT 'work_trip', name, concat('type: ', expense_type), CAST(SUM(amount) AS DOUBLE) FROM tt WHERE expense_type IS NOT NULL GROUP BY trip_id, name, expense_type
    UNION ALL SELECT 'deduction', 'wfh', 'weeks', 48 UNION ALL SELECT 'deduction', 'wfh', 'allocation_pct', 100 UNION ALL SELECT 'deduction', 'wfh', 'amount', 1222.08""",
)
def q11b(spark, d):
    """The lines of the return that come from a splits table, trips, overrides and the home office."""
    txns, shares = _shares(spark, d)
    trips, expenses = _trips(spark, d)
    out = tax.tax_return(txns, M.TAX, M.FY, splits=shares, trips=trips, trip_expenses=expenses, overrides=_tax_overrides(spark, d))
    return out.where(F.col("section").isin("override", "work_trip", "deduction") | ((F.col("section") == "business") & (F.col("label") == "expenses")))


@query("Q14b_trips_list", f"WITH {TRIPS} SELECT trip_id, name, fy, strftime(start_date, '%Y-%m-%d') AS start_date FROM trips")
def q14b(spark, d):
    return dims.list_trips(_trips(spark, d)[0]).select("trip_id", "name", "fy", "start_date")


@query("Q14c_overrides_list", f"WITH {Q.EVENTS}, {TAX_OVERRIDES} SELECT fy, section, label, {Q.money('amount', 'amount')} FROM ov")
def q14c(spark, d):
    return dims.list_overrides(_tax_overrides(spark, d)).select("fy", "section", "label", "amount")


@query(
    "Q14d_categories_list",
    f"""WITH {Q.TXN}, c AS (SELECT category, COUNT(*) AS n FROM txn GROUP BY 1) SELECT category, n FROM c""",
)
def q14d(spark, d):
    """Categories in use, from the transactions, in the order of the list."""
    used = M.txns(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return dims.list_categories(used)


@query(
    "H01_holding_upsert",
    f"""WITH {Q.EVENTS} SELECT concat('H', CAST(user_id AS VARCHAR)) AS name, seq, {Q.money('value', 'cost_basis')} FROM log
      WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1""",
)
def h01(spark, d):
    return H.latest_snapshots(M.holding_snapshots(spark, d)).select("name", "seq", "cost_basis")


@query(
    "H02_holding_state",
    f"""WITH {Q.EVENTS},
    snap AS (SELECT * FROM log WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1),
    folded AS (SELECT s.user_id, SUM(CASE e.event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) AS du,
        SUM(CASE WHEN e.event_type = 'purchase' THEN e.value ELSE 0 END) AS dc, arg_max(e.value, e.seq) FILTER (e.event_type = 'view') AS v
      FROM snap s JOIN log e ON e.user_id = s.user_id AND e.seq > s.seq AND e.event_type <> 'signup' GROUP BY 1)
    SELECT s.user_id AS holding_id, CAST(10 + COALESCE(du, 0) AS DOUBLE) AS units, CAST(s.value + COALESCE(dc, 0) AS DOUBLE) AS cost_basis,
      CAST(COALESCE(v, CASE WHEN s.user_id % 3 = 0 THEN s.value * 2 END) AS DOUBLE) AS current_value
    FROM snap s LEFT JOIN folded f ON f.user_id = s.user_id""",
)
def h02(spark, d):
    state = H.holding_state(M.holding_snapshots(spark, d), M.holding_events(spark, d))
    return state.select("holding_id", "units", "cost_basis", "current_value")


@query(
    "H03_events_by_holding",
    f"""WITH {Q.EVENTS} SELECT user_id AS holding_id, seq, strftime(event_date, '%Y-%m-%d') AS event_date,
      CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'click' THEN 'sell' WHEN 'view' THEN 'valuation' ELSE 'dividend' END AS event_type
    FROM log WHERE event_type <> 'signup'""",
)
def h03(spark, d):
    return H.events_by_holding(M.holding_events(spark, d)).select("holding_id", "seq", "event_date", "event_type")


@query(
    "K04_write_tags",
    f"""WITH {Q.TXN}, {Q.EVENTS}, more AS (SELECT DISTINCT txn_id, CASE WHEN user_id % 2 = 0 THEN 'mobile' ELSE 'checked' END AS tag FROM log),
    bridge AS (SELECT txn_id, unnest(tags) AS tag FROM txn UNION SELECT txn_id, tag FROM more)
    SELECT txn_id, tag FROM bridge""",
)
def k04(spark, d):
    more = M.edit_log(spark, d).select(
        "txn_id", F.when(F.col("user_id") % 2 == 0, "mobile").otherwise("checked").alias("tag")
    )
    return ST.tag_bridge(ST.add_tags(M.txns(spark, d), more))


@query(
    "K05_replace_splits_fy",
    f"""WITH {Q.SPLITS} SELECT txn_id, business, fy, {Q.money('CASE WHEN fy = 1998 THEN business_amount ELSE business_amount * 2 END', 'business_amount')} FROM splits""",
)
def k05(spark, d):
    from tallyloom.functions.scalars import fy_of

    txns = M.txns(spark, d).withColumn("fy", fy_of("txn_date"))
    columns = ("txn_id", "business", "fy", "business_amount")
    old = SP.compute_splits(txns, M.TAX).withColumn("business_amount", F.col("business_amount") * 2).select(*columns)
    return ST.replace_splits_of_fy(old, SP.compute_splits(txns, M.TAX, M.FY).select(*columns), M.FY)


@query(
    "J14_delete_semi",
    f"""WITH {Q.SPLITS} SELECT txn_id, business FROM splits WHERE txn_date NOT BETWEEN DATE '1997-07-01' AND DATE '1998-06-30'""",
)
def j14(spark, d):
    txns = M.txns(spark, d)
    return E.delete_splits_of_fy(SP.compute_splits(txns, M.TAX), txns, M.FY).select("txn_id", "business")


@query(
    "R07_backfill_with_overrides",
    f"""WITH {OVERRIDES}, bf AS (SELECT fy, COALESCE(MAX(seq), -1) AS at FROM (SELECT CAST(1990 + user_id % 12 AS INTEGER) AS fy, seq FROM log WHERE event_type = 'error') GROUP BY 1),
    live AS (SELECT o.* FROM o JOIN txn t ON t.txn_id = o.txn_id LEFT JOIN bf ON bf.fy = t.fy WHERE bf.at IS NULL OR o.seq > bf.at),
    lst AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY txn_id, business ORDER BY seq DESC) = 1)
    SELECT s.txn_id, s.business, {Q.money('s.business_amount', 'business_amount')}
      FROM splits s WHERE NOT EXISTS (SELECT 1 FROM lst l WHERE l.txn_id = s.txn_id AND l.business = s.business)
    UNION ALL SELECT l.txn_id, l.business, CAST(ROUND(t.amount * l.pct * 0.01::DECIMAL(3,2), 2) AS DOUBLE)
      FROM lst l JOIN txn t ON t.txn_id = l.txn_id WHERE l.pct <> 0""",
)
def r07(spark, d):
    from tallyloom.functions.scalars import fy_of

    txns = M.txns(spark, d).withColumn("fy", fy_of("txn_date"))
    log = M.edit_log(spark, d)
    runs = log.where(F.col("event_type") == "error").select((F.col("user_id") % 12 + 1990).cast("int").alias("fy"), "seq")
    live = E.since_backfill(_override_log(spark, d), txns, runs)
    out = E.apply_split_overrides(SP.compute_splits(txns, M.TAX), live, txns, M.TAX)
    return out.select("txn_id", "business", "business_amount")


@query(
    "R08_splits_at_ingest",
    f"""WITH {Q.SPLITS} SELECT txn_id, array_to_string(list_sort(list(business)), ',') AS businesses FROM splits GROUP BY 1""",
)
def r08(spark, d):
    rows = SP.with_computed_splits(RULES.classify(M.raw(spark, d), M.SETTINGS), M.TAX).where(F.size("splits") > 0)
    return rows.select("txn_id", F.array_sort(F.transform("splits", lambda s: s["business"])).alias("businesses"))
