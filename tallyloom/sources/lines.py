"""Lines of extracted statement text: from text files, or from a statement_lines table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.cells import files, with_seq


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """file, block, seq, text of every line below a path. Large files are split, small ones share tasks."""
    return with_seq(
        files(spark.read, glob)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value").alias("text"),
        )
    )


def lines_of_table(statement_lines: DataFrame) -> DataFrame:
    """From (file_name, page_no, line_no, text)."""
    return statement_lines.select(
        F.col("file_name").alias("file"), F.col("page_no").alias("block"), F.col("line_no").alias("seq"), "text"
    )


def lines_of_texts(texts: DataFrame, file: str, text: str) -> DataFrame:
    """From whole texts, one per row: split at newlines in the row that holds them."""
    return texts.select(F.col(file).cast("string").alias("file"), F.posexplode(F.split(text, "\n")).alias("seq", "text")).select(
        "file", F.lit(0).alias("block"), F.col("seq").cast("long").alias("seq"), "text"
    )
