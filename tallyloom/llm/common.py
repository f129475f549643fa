"""Helpers shared by the operators: input columns, held-out split, text batches."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyloom.session import READING

#: whitespace between words: space and \x09-\x0D
SPACE = r"[\x20\x09-\x0D]+"
FOLDS = 4
HELD_OUT_FOLD = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.options(**READING).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether crc32 of the id's decimal text leaves the remainder of the held-out fold; a null id is held out."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    fold = F.crc32(key.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(True))


def sampled(df: DataFrame, key: str, bound: int, *strata: str) -> DataFrame:
    """About ``bound`` rows (per stratum), chosen by a hash of ``key``: the rows with the smallest hashes.

    The same rows are chosen on every run and in every partitioning. Strata that are smaller than the bound are taken whole.
    Counting reads only the key and the strata; the factor that follows from it is a filter, not a sort.
    """
    share = (F.xxhash64(F.col(key).cast("string")).cast("double") / F.lit(2.0**64)) + 0.5
    if not strata:
        n = df.count()
        return df.where(share <= F.lit(min(1.0, bound / max(n, 1))))
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    on = [df[s].eqNullSafe(counts[s]) for s in strata]
    joined = df.join(counts, on)
    for s in strata:
        joined = joined.drop(counts[s])
    return joined.where(share <= F.lit(float(bound)) / F.col("_n")).drop("_n")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch, null as empty."""
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def by_size(texts: Sequence[str], chars: int = 500_000) -> Iterator[slice]:
    """Consecutive slices of about ``chars`` characters, at least one text each: bounds what a step holds in memory."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= chars:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


#: bytes of a batch that a step gets at once
PIECE_BYTES = 4 << 20
#: rows that Spark hands to Python at once, unless the session says otherwise than Spark's own ten thousand: texts may be very long
BATCH_ROWS, BATCH_SETTING = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: likewise their bytes, instead of Spark's own 64 MB
BYTES_SETTING, SPARKS_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)


def rows_of(batch: pa.RecordBatch) -> int:
    """Rows of the batch that hold about ``PIECE_BYTES``."""
    return max(1, int(batch.num_rows * PIECE_BYTES / max(batch.nbytes, 1)))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of the cluster, once per application, and see to batches of long texts."""
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    if spark.conf.get(BYTES_SETTING).rstrip("b") == SPARKS_BYTES:
        spark.conf.set(BYTES_SETTING, str(PIECE_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def map_batches(df: DataFrame, step, schema: str | StructType) -> DataFrame:
    """``step(batch)`` yields dicts of columns, over Arrow batches."""
    ship(df.sparkSession)
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (b.slice(at, n) for b in batches for n in [rows_of(b)] for at in range(0, b.num_rows, n))
        for piece in pieces:
            for out in step(piece):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)
