"""Landed open-banking records (JSON lines or arrays)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import scalars as S
from tallyloom.schema import MONEY
from tallyloom.sources import cells as C

TEXT_FIELDS = ("id", "status", "amount", "postDate", "description", "currency", "direction", "class", "balance", "institution", "connection", "enrich")
#: everything as text: the provider sends amounts as strings, and nested members are kept as they are
SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in TEXT_FIELDS])
AUDITED = ("direction", "class", "balance", "institution", "connection", "status", "enrich")


def _rows(df: DataFrame) -> DataFrame:
    return df.select(
        *TEXT_FIELDS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def read_records(spark: SparkSession, path: str | list[str], glob: str | None = None, multi_line: bool = False) -> DataFrame:
    reader = C.files(spark.read.schema(SCHEMA).options(multiLine=multi_line), glob)
    return C.with_seq(_rows(reader.json(path)))


def parse_openbanking(rows: DataFrame, source_type: str, rank: int = 9) -> DataFrame:
    """Posted records only; the date is the first ten characters of the post date.

    Records without an id would all share one identity; they go to quarantine.
    """
    date = F.substring(F.coalesce("postDate", F.lit("")), 1, 10)
    parsed = F.try_to_date(date, "yyyy-MM-dd")
    text = F.coalesce(F.col("amount"), F.lit("0"))
    amount = F.trim(text).try_cast(MONEY)
    raw = F.create_map(
        F.lit("basiq_id"), F.col("id"), *[x for n in AUDITED for x in (F.lit(n), F.col(n))]
    )
    nameless = F.trim(F.coalesce("id", F.lit(""))) == ""
    reject = (
        F.when(parsed.isNull(), F.lit("unreadable date")).when(amount.isNull(), F.lit("unreadable amount")).when(nameless, F.lit("no record id"))
    )
    return rows.where(F.col("status") == "posted").select(
        *C.record(
            txn_date=parsed,
            date_raw=date,
            description=F.coalesce("description", F.lit("")),
            amount=amount,
            source_type=source_type,
            source_rank=rank,
            reject=reject,
            raw=raw,
            currency=F.coalesce("currency", F.lit("AUD")),
            reference_id=F.concat(F.lit(S.AGGREGATOR_PREFIX), F.coalesce("id", F.lit(""))),
        )
    )


def read_openbanking_json(spark: SparkSession, path: str, source_type: str) -> DataFrame:
    return parse_openbanking(read_records(spark, path), source_type)


def last_synced(txns: DataFrame) -> DataFrame:
    """Per source the newest date that came from the aggregator."""
    synced = txns.where(F.col("reference_id").startswith(S.AGGREGATOR_PREFIX))
    return synced.groupBy("source_type").agg(F.max("txn_date").alias("since"))


def incremental_since(records: DataFrame, txns: DataFrame) -> DataFrame:
    """Records not older than the newest synced date of their source, that day included; all of a new source.

    Undated records are passed on: they belong in quarantine, where they can be seen.

    The join side has one row per configured source.
    """
    joined = records.join(last_synced(txns), "source_type", "left")
    return joined.where(F.col("since").isNull() | F.col("txn_date").isNull() | (F.col("txn_date") >= F.col("since"))).drop("since")
