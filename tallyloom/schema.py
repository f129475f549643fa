"""Fixed schemas. Money is decimal everywhere, dates are dates, sign convention: negative = money out."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
TOTAL = T.DecimalType(28, 2)
RATE = T.DecimalType(18, 6)
PCT = T.DecimalType(7, 4)
HOME_CURRENCY = "AUD"

#: position of a record among all records of one ingest: registry order, file, block of the file, order in the block
ARRIVAL = T.StructType(
    [
        T.StructField("source_rank", T.IntegerType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)

RAW_TXN = T.StructType(
    [
        T.StructField("txn_date", T.DateType()),
        T.StructField("date_raw", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("amount", MONEY),
        T.StructField("currency", T.StringType()),
        T.StructField("original_amount", MONEY),
        T.StructField("original_currency", T.StringType()),
        T.StructField("fee", MONEY),
        T.StructField("reference_id", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("raw", T.MapType(T.StringType(), T.StringType())),
        T.StructField("arrival", ARRIVAL),
    ]
)

#: why a parsed record is not a transaction; NULL when it is one
REJECT = "reject_reason"

TXN = T.StructType(
    [
        T.StructField("txn_id", T.StringType()),
        T.StructField("dedup_hash", T.StringType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("txn_date", T.DateType()),
        T.StructField("description", T.StringType()),
        T.StructField("amount", MONEY),
        T.StructField("currency", T.StringType()),
        T.StructField("original_amount", MONEY),
        T.StructField("original_currency", T.StringType()),
        T.StructField("fee", MONEY),
        T.StructField("category", T.StringType()),
        T.StructField("confidence", T.DecimalType(3, 1)),
        T.StructField("reference_id", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("is_transfer", T.BooleanType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("notes", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("arrival", ARRIVAL),
        T.StructField("fy", T.IntegerType()),
    ]
)

ACCOUNTS = T.StructType(
    [
        T.StructField("account_id", T.StringType()),
        T.StructField("account_name", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("account_type", T.StringType()),
        T.StructField("display", T.BooleanType()),
    ]
)

CATEGORIES = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("is_income", T.BooleanType()),
        T.StructField("budget_monthly", MONEY),
    ]
)

FX_RATES = T.StructType(
    [
        T.StructField("txn_date", T.DateType()),
        T.StructField("from_currency", T.StringType()),
        T.StructField("to_currency", T.StringType()),
        T.StructField("rate", RATE),
    ]
)

SPLITS = T.StructType(
    [
        T.StructField("txn_id", T.StringType()),
        T.StructField("business", T.StringType()),
        T.StructField("business_ord", T.IntegerType()),
        T.StructField("business_pct", PCT),
        T.StructField("business_amount", MONEY),
        T.StructField("fy", T.IntegerType()),
    ]
)
