"""The driver's tables seen as accounts and transactions.

``customer`` becomes accounts, ``orders`` transactions, ``events`` an edit and holdings log, ``documents`` statement
lines, ``lineitem`` the conversion rows of foreign payments. Rows are never selected by id: each mapping covers its
whole table.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.config import (
    Account,
    Business,
    Category,
    DepreciationItem,
    ExpenseMap,
    ManualEntry,
    RentalProperty,
    Rule,
    Settings,
    SplitRule,
    TagRule,
    TaxConfig,
    WfhEntry,
)
from tallyloom.operators.rules import classify

FY = 1998
YEAR = 1998

TAX = TaxConfig(
    financial_year=FY,
    taxpayer="A Holder",
    spouse_name="B Holder",
    spouse_income=Decimal(90000),
    businesses=(
        Business(
            "North Studio",
            "11000000001",
            "Design",
            (SplitRule("Utilities", "mobile", Decimal(20)), SplitRule("Utilities", "internet", Decimal(50))),
        ),
        Business("South Studio", "11000000002", "Print", (SplitRule("Groceries", "small-no", Decimal("12.5")),)),
    ),
    rental_properties=(
        RentalProperty(
            "Harbour Unit",
            "1 Quay St",
            Decimal(50),
            {FY: 20},
            "Airbnb Income",
            (
                ExpenseMap("Body corporate fees", category="Groceries"),
                ExpenseMap("Interest on loans", category="Utilities"),
                ExpenseMap("Water charges", tag="water"),
                ExpenseMap("Repairs and maintenance", category="Business: Software"),
            ),
        ),
        RentalProperty(
            "Hill House", "2 Ridge Rd", Decimal("33.3333"), {}, "Salary", (ExpenseMap("Phone", tag="mobile"),)
        ),
    ),
    depreciation=(
        DepreciationItem("Rental capital allowances", "rental", "Harbour Unit", "Capital allowances", Decimal(100), FY),
        DepreciationItem("Business equipment", "business", "North Studio", "Laptop", Decimal(500), FY),
        DepreciationItem("Business equipment", "business", "North Studio", "Desk", Decimal("250.50"), FY + 1),
    ),
    wfh_entries=(WfhEntry(FY, Decimal(48), Decimal(100)), WfhEntry(FY + 1, Decimal(40), Decimal(50))),
    manual_entries=(
        ManualEntry(FY, "Tax withheld", Decimal(50000), "income", "From payment summary"),
        ManualEntry(FY, "Union fees", Decimal("310.20"), "deduction", ""),
        ManualEntry(FY, "Tax withheld", Decimal(51000), "income", "Corrected"),
    ),
)

SETTINGS = Settings(
    accounts=(
        Account("Provider", "paypal", account_type="other", source_of_truth=True, payment_patterns=("STORE 7$",)),
        Account("Card", "hsbc", account_type="credit", source_of_truth=True),
    ),
    categories=(
        Category("Airbnb Income", True),
        Category("Business: Software"),
        Category("Groceries", False, Decimal(600)),
        Category("Salary", True),
        Category("Transfers"),
        Category("Uncategorized"),
        Category("Utilities", False, Decimal(300)),
        Category("Strata", False, Decimal(50)),
    ),
    rules=(
        Rule("source", "Airbnb Income", source_type="airbnb"),
        Rule("exact", "Groceries", "NOT SPECIFIED"),
        Rule("regex", "Business: Software", "^URGENT .*STORE 1"),
        Rule("regex", "Undefined category", "^URGENT .*STORE"),
        Rule("regex", "Utilities", "^URGENT"),
        Rule("regex", "Transfers", "STORE 2$"),
        Rule("regex", "Salary", "^(HIGH|MEDIUM)"),
    ),
    tag_rules=(
        TagRule("small-no", "STORE [0-9]$"),
        TagRule("internet", "FURNITURE"),
        TagRule("mobile", "^URGENT"),
        TagRule("water", "STORE 4[0-9]$"),
    ),
    tax=TAX,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _account_type(segment: Column) -> Column:
    return (
        F.when(segment == "HOUSEHOLD", "checking")
        .when(segment == "FURNITURE", "savings")
        .when(segment == "AUTOMOBILE", "credit")
        .when(segment == "BUILDING", "loan")
        .otherwise("other")
    )


def _source_type(key: Column) -> Column:
    names = F.array(*[F.lit(n) for n in ("ing", "paypal", "hsbc", "amex", "airbnb")])
    return F.get(names, (key % 5).cast("int"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("account_id"),
        F.col("c_name").alias("account_name"),
        _source_type(key).alias("source_type"),
        F.lit("AUD").alias("currency"),
        _account_type(F.col("c_mktsegment")).alias("account_type"),
        (key % 20 != 0).alias("display"),
    )


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions before classification, with the columns of their account.

    Odd accounts hold foreign payments: every third order is in USD.
    """
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    key = F.col("o_orderkey")
    amount = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    text = F.concat(
        F.substring("o_orderpriority", 3, 100),
        F.lit(" "),
        F.col("c_mktsegment"),
        F.lit(" STORE "),
        (key % 50).cast("string"),
    )
    money = amount.cast("decimal(18,2)")
    foreign = (F.col("o_custkey") % 2 == 1) & (key % 3 == 0)
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("txn_id"),
        key.alias("arrival"),
        F.col("o_custkey").alias("account_id"),
        F.col("c_name").alias("account_name"),
        _account_type(F.col("c_mktsegment")).alias("account_type"),
        _source_type(F.col("o_custkey")).alias("source_type"),
        F.col("o_orderdate").cast("date").alias("txn_date"),
        text.alias("description"),
        money.alias("amount"),
        F.when(foreign, F.round(money * F.lit("0.7").cast("decimal(2,1)"), 2).cast("decimal(18,2)")).alias(
            "original_amount"
        ),
        F.when(foreign, F.lit("USD")).alias("original_currency"),
        F.lit(None).cast("string").alias("reference_id"),
        F.concat(F.lit("/in/"), _source_type(F.col("o_custkey")), F.lit("_"), F.col("o_custkey"), F.lit(".csv")).alias(
            "source_file"
        ),
    )


def txns(spark: SparkSession, sf_dir: str, learned: DataFrame | None = None) -> DataFrame:
    return classify(raw(spark, sf_dir), SETTINGS, learned)


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as edits of transactions: a category or a note each."""
    events = table(spark, sf_dir, "events")
    orders = table(spark, sf_dir, "orders").agg(F.count(F.lit(1))).scalar()
    kind = F.col("event_type")
    category = (
        F.when(kind == "purchase", "Groceries")
        .when(kind == "click", "Utilities")
        .when(kind == "view", "Salary")
        .when(kind == "error", "No such category")
    )
    note = F.when(
        (kind == "signup") & (F.col("user_id") % 7 != 0), F.concat(F.lit("note "), F.col("event_id").cast("string"))
    )
    return events.select(
        (F.col("event_id") % orders).alias("txn_id"),
        F.col("event_id").alias("seq"),
        kind.alias("event_type"),
        category.alias("new_category"),
        note.alias("new_notes"),
        (kind == "signup").alias("has_notes"),
        "user_id",
        F.col("value").cast("decimal(18,2)").alias("value"),
        F.col("ts").cast("date").alias("event_date"),
    )


ASSET_TYPES = ("property", "vehicle", "shares", "super", "crypto", "boat")


def holding_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``signup`` events set a user's holding anew."""
    kinds = F.array(*[F.lit(a) for a in ASSET_TYPES])
    rows = edit_log(spark, sf_dir).where(F.col("event_type") == "signup")
    return rows.select(
        F.get(kinds, (F.col("user_id") % len(ASSET_TYPES)).cast("int")).alias("asset_type"),
        F.concat(F.lit("H"), F.col("user_id").cast("string")).alias("name"),
        F.col("user_id").alias("holding_id"),
        "seq",
        F.lit(None).cast("string").alias("ticker"),
        F.lit(10).cast("decimal(28,6)").alias("units"),
        F.col("value").alias("cost_basis"),
        F.when(F.col("user_id") % 3 == 0, F.col("value") * 2).cast("decimal(18,2)").alias("current_value"),
        F.col("event_date").alias("as_at_date"),
        F.lit(None).cast("string").alias("notes"),
    )


def holding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases buy, clicks sell, views value, errors pay a dividend."""
    kind = F.col("event_type")
    names = F.when(kind == "purchase", "buy").when(kind == "click", "sell").when(kind == "view", "valuation")
    rows = edit_log(spark, sf_dir).where(kind != "signup")
    return rows.select(
        F.col("user_id").alias("holding_id"),
        "seq",
        "event_date",
        names.otherwise("dividend").alias("event_type"),
        F.lit(1).cast("decimal(28,6)").alias("units"),
        F.col("value").alias("total_value"),
    )


def with_recorded_raw(rows: DataFrame) -> DataFrame:
    """A raw record per transaction: a balance under one of three keys, blank or unreadable now and then."""
    key = F.col("txn_id")
    text = F.col("amount").cast("string")
    return rows.withColumn(
        "raw",
        F.create_map(
            F.lit("closing_balance"),
            F.when(key % 4 == 0, text).when(key % 4 == 1, "0.00").otherwise(""),
            F.lit("Balance"),
            F.when(key % 8 == 1, "n/a").when(key % 3 == 0, F.format_number(F.col("amount"), 2)),
            F.lit("balance"),
            F.when(key % 5 == 0, "0").when(key % 5 == 1, text),
        ),
    )


# --- statements: the transactions written as the files each provider would export -------------------------------------


def _plain_money(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def ing_csv_rows(rows: DataFrame) -> DataFrame:
    """Credits and debits in two columns; some rows have no usable date or amount."""
    bad_date = F.col("txn_id") % 89 == 0
    no_amount = F.col("txn_id") % 83 == 0
    grouped = F.format_number("amount", 2)
    return rows.select(
        F.when(bad_date, "31/02/2020").otherwise(F.date_format("txn_date", "dd/MM/yyyy")).alias("Date"),
        F.col("description").alias("Description"),
        F.when(~no_amount & (F.col("amount") > 0), F.concat(F.lit("$"), grouped)).otherwise("").alias("Credit"),
        F.when(~no_amount & (F.col("amount") < 0), grouped).otherwise("").alias("Debit"),
        F.lit("1.00").alias("Balance"),
    )


def bankwest_csv_rows(rows: DataFrame) -> DataFrame:
    """Every row fills the credit column; a debit beside it wins."""
    return rows.select(
        F.lit("302-985").alias("BSB Number"),
        F.col("account_id").alias("Account Number"),
        F.date_format("txn_date", "d/M/yyyy").alias("Transaction Date"),
        F.col("description").alias("Narration"),
        F.lit("").alias("Cheque Number"),
        F.when(F.col("amount") < 0, _plain_money(-F.col("amount"))).otherwise("0.00").alias("Debit"),
        _plain_money(F.abs("amount")).alias("Credit"),
        F.lit("1.00").alias("Balance"),
        F.lit("WDL").alias("Transaction Type"),
    )


def amex_csv_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.date_format("txn_date", "dd/MM/yyyy").alias("Date"),
        F.col("description").alias("Description"),
        F.lit("A HOLDER").alias("Card Member"),
        F.col("account_id").alias("Account #"),
        _plain_money(-F.col("amount")).alias("Amount"),
        F.coalesce(_plain_money(-F.col("original_amount")), F.lit("")).alias("Foreign Spend Amount"),
        F.lit("").alias("Commission"),
        F.lit("").alias("Exchange Rate"),
    )


def airbnb_csv_rows(rows: DataFrame) -> DataFrame:
    """Net payout is blank or zero now and then, so that the gross amount counts."""
    case = F.col("txn_id") % 3
    net = F.when(case == 0, "").when(case == 1, "0.00").otherwise(F.format_number("amount", 2))
    return rows.select(
        F.date_format("txn_date", "dd/MM/yyyy").alias("Payout date"),
        F.col("description").alias("Type"),
        F.lit("").alias("Listing Name"),
        F.lit("").alias("Guest name"),
        F.format_number("amount", 2).alias("Gross earnings"),
        F.lit("-3.50").alias("Host fee"),
        net.alias("Net payout"),
        F.concat(F.lit("HM"), F.col("txn_id").cast("string")).alias("Confirmation code"),
    )


def paypal_csv_rows(rows: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Payments of every order, foreign ones in USD, and a conversion row per order line.

    Lines with an even number convert into the home currency, others out of the foreign one; ``lineitem`` repeats
    (order, line) pairs, so a payment may have many conversion rows.
    """
    columns = ("Date", "Description", "Status", "Currency", "Gross", "Fee", "Transaction ID", "Name", "Reference Txn ID")
    foreign = F.col("original_currency").isNotNull()
    key = F.col("txn_id")
    payments = rows.select(
        F.date_format("txn_date", "d/MM/yyyy"),
        F.when(key % 41 == 0, "Temporary Hold").otherwise("Express Checkout Payment"),
        F.when(key % 43 == 0, "Pending").otherwise("Completed"),
        F.coalesce("original_currency", F.lit("AUD")),
        F.when(foreign, F.format_number("original_amount", 2)).otherwise(F.format_number("amount", 2)),
        F.lit("-0.30"),
        F.concat(F.lit("T"), key.cast("string")),
        F.col("description"),
        F.lit(""),
        key,
    )
    home = F.col("l_linenumber") % 2 == 0
    line = F.col("l_linenumber").cast("string")
    order = F.col("l_orderkey").cast("string")
    conversions = lineitem.select(
        F.lit("1/01/2000"),
        F.lit("General Currency Conversion"),
        F.lit("Completed"),
        F.when(home, "AUD").otherwise("USD"),
        # one figure per order, so that which of its conversion rows comes first does not matter
        F.concat(F.lit("-"), F.when(home, (F.col("l_orderkey") % 1000 + 1).cast("string")).otherwise("1"), F.lit(".25")),
        F.lit("0.00"),
        F.concat(F.lit("C"), order, F.lit("-"), line),
        F.lit(""),
        F.concat(F.lit("T"), order),
        F.col("l_orderkey"),
    )
    # a payment and its conversion rows stand in one file
    return payments.union(conversions).toDF(*columns, "_order").repartition("_order").drop("_order")


def hsbc_text_rows(rows: DataFrame) -> DataFrame:
    """Card statement entries over two lines; purchases are positive."""
    amount = F.format_number(-F.col("amount"), 2)
    return rows.select(
        F.concat(F.date_format("txn_date", "dd MMM yyyy"), F.lit(" "), F.col("description"), F.lit("\nRef no"), F.lit("  "), amount)
    )


def ing_text_rows(rows: DataFrame) -> DataFrame:
    """A section per entry: header, entry over three lines, sometimes closed by a footer with text behind it."""
    money = F.format_number("amount", 2)
    closed = F.when(F.col("txn_id") % 3 == 0, "\nTotal Fees Financial Year 1.00\n05/05/2005 not an entry 1.00 2.00").otherwise("")
    return rows.select(
        F.concat(
            F.lit("Date  Details  Money out $  Money in $  Balance $\n"),
            F.date_format("txn_date", "dd/MM/yyyy"),
            F.lit(" Purchase\n"),
            F.col("description"),
            F.lit("  "),
            money,
            F.lit("   1,000.00\nCard 1234"),
            closed,
        )
    )


def bankwest_text_rows(rows: DataFrame) -> DataFrame:
    """Credits are told by their words, foreign amounts stand on a line of their own."""
    word = F.when(F.col("amount") > 0, " REFUND").otherwise("")
    foreign = F.when(F.col("original_currency").isNotNull(), "\n12.99 USD").otherwise("")
    return rows.select(
        F.concat(
            F.lit("Date Description Debit Credit\n"),
            F.date_format("txn_date", "dd MMM yy"),
            F.lit(" "),
            F.col("description"),
            word,
            F.lit("  $"),
            F.format_number(F.abs("amount"), 2),
            foreign,
        )
    )


def coles_text_rows(rows: DataFrame) -> DataFrame:
    """Dates with a slash, posting date behind the transaction date, CR for credits."""
    day = F.date_format("txn_date", "dd/MM/yyyy")
    credit = F.when(F.col("amount") > 0, " CR").otherwise("")
    return rows.select(
        F.concat(
            F.lit("Transaction Date Post Date Description Amount\n"),
            day,
            F.lit(" "),
            F.date_format("txn_date", "dd/MM"),
            F.lit(" "),
            F.col("description"),
            F.lit("\nPage 1\n$"),
            F.format_number(F.abs("amount"), 2),
            credit,
        )
    )


def openbanking_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("txn_id").cast("string").alias("id"),
        F.when(F.col("txn_id") % 17 == 0, "pending").otherwise("posted").alias("status"),
        _plain_money(F.col("amount")).alias("amount"),
        F.concat(F.date_format("txn_date", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("postDate"),
        "description",
        F.lit("AUD").alias("currency"),
        F.when(F.col("amount") > 0, "credit").otherwise("debit").alias("direction"),
    )


def write_csv(rows: DataFrame, path: str) -> str:
    rows.write.csv(path, header=True, escape='"', emptyValue="")
    return path


def write_text(rows: DataFrame, path: str) -> str:
    rows.write.text(path)
    return path


def records(rows: DataFrame, rank: int = 0) -> DataFrame:
    """Transactions as RAW_TXN records, without a detour over files."""
    return rows.select(
        "txn_date",
        F.date_format("txn_date", "yyyy-MM-dd").alias("date_raw"),
        "description",
        "amount",
        F.lit("AUD").alias("currency"),
        "original_amount",
        "original_currency",
        F.lit(rank).cast("decimal(18,2)").alias("fee"),
        F.when(F.col("source_type") == "paypal", F.concat(F.lit("T"), F.col("txn_id").cast("string"))).alias("reference_id"),
        "source_type",
        "source_file",
        F.create_map(F.lit("balance"), F.col("amount").cast("string")).alias("raw"),
        F.struct(
            F.lit(rank).alias("source_rank"),
            F.lit("x").alias("file_name"),
            F.lit(0).cast("long").alias("block"),
            F.col("txn_id").alias("seq"),
        ).alias("arrival"),
        F.lit(None).cast("string").alias("reject_reason"),
    )
