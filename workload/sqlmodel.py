"""The mapping of ``workload.model`` once more, as common table expressions for the oracle SQL."""

from __future__ import annotations

ACCOUNTS = """
accounts AS (
  SELECT c_custkey AS account_id, c_name AS account_name,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'checking' WHEN 'FURNITURE' THEN 'savings' WHEN 'AUTOMOBILE' THEN 'credit'
      WHEN 'BUILDING' THEN 'loan' ELSE 'other' END AS account_type,
    CASE c_custkey % 5 WHEN 0 THEN 'ing' WHEN 1 THEN 'paypal' WHEN 2 THEN 'hsbc' WHEN 3 THEN 'amex'
      ELSE 'airbnb' END AS source_type,
    c_custkey % 20 <> 0 AS display, c_mktsegment
  FROM customer)"""

RAW = (
    ACCOUNTS
    + """,
raw AS (
  SELECT o_orderkey AS txn_id, o_custkey AS account_id, account_name, source_type, account_type, display,
    CAST(o_orderdate AS DATE) AS txn_date,
    concat(substr(o_orderpriority, 3), ' ', c_mktsegment, ' STORE ', CAST(o_orderkey % 50 AS VARCHAR)) AS description,
    CAST(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2)) AS amount,
    o_custkey % 2 = 1 AND o_orderkey % 3 = 0 AS is_foreign,
    concat('/in/', source_type, '_', CAST(o_custkey AS VARCHAR), '.csv') AS source_file
  FROM orders JOIN accounts ON account_id = o_custkey)"""
)

PAYMENT = "(regexp_matches(description, 'STORE 7$') AND source_type NOT IN ('paypal', 'hsbc'))"


def category_case(learned: str | None = None) -> str:
    fallback = "'Uncategorized'" if learned is None else f"coalesce({learned}, 'Uncategorized')"
    return f"""CASE WHEN {PAYMENT} THEN 'Transfers' WHEN source_type = 'airbnb' THEN 'Airbnb Income'
      WHEN contains(description, 'NOT SPECIFIED') THEN 'Groceries'
      WHEN regexp_matches(description, '^URGENT .*STORE 1') THEN 'Business: Software'
      WHEN description LIKE 'URGENT%' THEN 'Utilities'
      WHEN regexp_matches(description, 'STORE 2$') THEN 'Transfers'
      WHEN regexp_matches(description, '^(HIGH|MEDIUM)') THEN 'Salary' ELSE {fallback} END"""


CONFIDENCE = f"""CASE WHEN {PAYMENT} THEN 1.0 WHEN source_type = 'airbnb' THEN 1.0
      WHEN contains(description, 'NOT SPECIFIED') THEN 0.9
      WHEN description LIKE 'URGENT%' OR regexp_matches(description, 'STORE 2$')
        OR regexp_matches(description, '^(HIGH|MEDIUM)') THEN 0.8 ELSE 0.0 END"""

TAGS = """list_filter([CASE WHEN regexp_matches(description, 'STORE [0-9]$') THEN 'small-no' END,
      CASE WHEN contains(description, 'FURNITURE') THEN 'internet' END,
      CASE WHEN description LIKE 'URGENT%' THEN 'mobile' END,
      CASE WHEN regexp_matches(description, 'STORE 4[0-9]$') THEN 'water' END], lambda x: x IS NOT NULL)"""

TXN = (
    RAW
    + f""",
classified AS (SELECT *, {category_case()} AS category, CAST({CONFIDENCE} AS DECIMAL(3,1)) AS confidence,
    {TAGS} AS tags FROM raw),
txn AS (SELECT *, category = 'Transfers' AS is_transfer,
    CAST(year(txn_date + INTERVAL 6 MONTH) AS INTEGER) AS fy FROM classified)"""
)

SPLITS = (
    TXN
    + """,
shares AS (
  SELECT txn_id, txn_date, fy, amount, 'North Studio' AS business, 0 AS business_ord,
    CAST(CASE WHEN category LIKE 'Business:%' THEN 100
      WHEN category = 'Utilities' AND list_contains(tags, 'mobile') THEN 20
      WHEN category = 'Utilities' AND list_contains(tags, 'internet') THEN 50 END AS DECIMAL(7,4)) AS business_pct
  FROM txn WHERE NOT is_transfer
  UNION ALL
  SELECT txn_id, txn_date, fy, amount, 'South Studio', 1,
    CAST(CASE WHEN category = 'Groceries' AND list_contains(tags, 'small-no') THEN 12.5 END AS DECIMAL(7,4))
  FROM txn WHERE NOT is_transfer),
splits AS (SELECT *, CAST(ROUND(amount * business_pct * 0.01::DECIMAL(3,2), 2) AS DECIMAL(18,2)) AS business_amount
  FROM shares WHERE business_pct IS NOT NULL)"""
)

FX = (
    RAW
    + """,
fx_raw AS (SELECT *, CASE WHEN is_foreign THEN CAST(ROUND(amount * 0.7::DECIMAL(2,1), 2) AS DECIMAL(18,2)) END
    AS original_amount, CASE WHEN is_foreign THEN 'USD' END AS original_currency FROM raw)"""
)

EVENTS = """
log AS (
  SELECT event_id % (SELECT count(*) FROM orders) AS txn_id, event_id AS seq, event_type,
    CASE event_type WHEN 'purchase' THEN 'Groceries' WHEN 'click' THEN 'Utilities' WHEN 'view' THEN 'Salary'
      WHEN 'error' THEN 'No such category' END AS new_category,
    CASE WHEN event_type = 'signup' AND user_id % 7 <> 0 THEN concat('note ', CAST(event_id AS VARCHAR)) END AS new_notes,
    event_type = 'signup' AS has_notes, user_id, CAST(value AS DECIMAL(18,2)) AS value, CAST(ts AS DATE) AS event_date
  FROM events)"""


def money(expr: str, name: str) -> str:
    return f"CAST({expr} AS DOUBLE) AS {name}"


def day(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d') AS {name}"
