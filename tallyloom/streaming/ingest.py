"""The same ingest as a stream: files that land in the staging folders, once each, into the store.

The stream lists files, and a micro-batch reads those it names with the reader of the batch ingest, so a large file is
split over tasks in both. Structured Streaming keeps track of which files were taken; the store recognises records it
has. Together a record is added exactly once, however often a batch is repeated and however late a statement arrives.
There is no watermark: a statement may be years old, so any state that forgets would add it twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.config import Settings
from tallyloom.session import removed
from tallyloom.sinks.store import Store
from tallyloom.sources.cells import escaped, files
from tallyloom.sources.registry import REGISTRY, Source

#: a file as a stream lists it, and as it is noted when it is in the store
LISTED = "path string, modificationTime timestamp, length long, content binary"
TAKEN = "path string, batch long"


def ingest_stream(
    spark: SparkSession,
    source: Source,
    staging: str,
    store_root: str,
    settings: Settings,
    checkpoint: str,
    *,
    archive: str | None = None,
    learned: DataFrame | None = None,
    hooks: Iterable[Callable[[DataFrame], DataFrame]] = (),
    max_files: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the stream of one source.

    The files of each batch are noted in a table beside the checkpoint when the batch is in the store. With ``archive``,
    a batch first moves the files of the batches before it, which are committed; ``archive_taken`` moves those of the
    last. ``max_files`` bounds the files of one micro-batch; any division into batches gives the same table.
    """
    options = {} if max_files is None else {"maxFilesPerTrigger": max_files}
    folder = f"{staging}/{source.folder}"
    listed = files(spark.readStream.format("binaryFile").schema(LISTED), source.glob).options(**options).load(folder).select("path")

    def add(batch: DataFrame, batch_id: int) -> None:
        """The batch's own session has adaptive execution switched off, which only the listing of files needs; what they hold is taken in by the caller's."""
        if archive is not None:
            archive_taken(spark, source, checkpoint, archive, before=batch_id)
        names = [row["path"] for row in batch.toLocalIterator()]  # names only, as the stream itself holds them
        if not names:
            return
        rows = source.read(spark, [escaped(n) for n in names], None)
        Store(spark, store_root).ingest(source.parse(rows), settings, learned, batch_id=batch_id, hooks=hooks)
        noted = spark.createDataFrame([(n, batch_id) for n in names], TAKEN)
        noted.write.mode("overwrite").parquet(f"{_taken(source, checkpoint)}/{batch_id}")

    writer = listed.writeStream.foreachBatch(add).option("checkpointLocation", f"{checkpoint}/{source.name}")
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.queryName(f"ingest-{source.name}").start()


def _taken(source: Source, checkpoint: str) -> str:
    return f"{checkpoint}/{source.name}-taken"


def taken_files(spark: SparkSession, source: Source, checkpoint: str) -> DataFrame:
    """path, batch of all files that are in the store."""
    try:
        return files(spark.read.schema(TAKEN)).parquet(_taken(source, checkpoint))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], TAKEN)


def moved(paths: DataFrame, archive: str) -> DataFrame:
    """path, moved: files moved below ``archive`` under their own path, by the executors. A file that is gone was moved before."""

    def located(uri: str) -> tuple[str, str]:
        """File system and path of a URI; without a host it is a path of the local file system."""
        parts = urlsplit(uri)
        if not parts.netloc:
            return "file:///", uri.removeprefix("file:").replace("///", "/")
        path = uri.split(parts.netloc, 1)[1]
        # an object store has the bucket in its paths
        return f"{parts.scheme}://{parts.netloc}/", parts.netloc + path if parts.scheme.startswith(("s3", "gs")) else path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        _, top = located(archive.rstrip("/"))
        for batch in batches:
            names, done = batch.column(0).to_pylist(), []
            for name in names:
                root, path = located(name)
                system, _ = fs.FileSystem.from_uri(root.replace("s3a://", "s3://"))
                target = f"{top}/{path.lstrip('/')}"
                found = system.get_file_info(path).type == fs.FileType.File
                if found:
                    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    system.move(path, target)
                done.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(done, pa.bool_())], names=["path", "moved"])

    return paths.select("path").mapInArrow(run, "path string, moved boolean")


def archive_taken(spark: SparkSession, source: Source, checkpoint: str, archive: str, before: int | None = None) -> int:
    """Move the files that are in the store (of batches before one) to the archive, and count them. A repeat moves the rest.

    What is noted of a batch goes when its files are moved. Staging and archive are on one file system, one that pyarrow
    can open on the executors.
    """
    taken = taken_files(spark, source, checkpoint)
    if before is not None:
        taken = taken.where(F.col("batch") < before)
    batches = [row["batch"] for row in taken.select("batch").distinct().collect()]
    if not batches:
        return 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = taken.where(F.col("batch").isin(batches)).select("path").distinct()
    count = moved(paths.repartition(tasks, "path"), archive).where("moved").count()
    removed(spark, *[f"{_taken(source, checkpoint)}/{n}" for n in batches])
    return count


def ingest_available(
    spark: SparkSession,
    staging: str,
    store_root: str,
    settings: Settings,
    checkpoint: str,
    *,
    sources: Iterable[str] | None = None,
    registry: dict[str, Source] = REGISTRY,
    archive: str | None = None,
    **options,
) -> None:
    """Take in everything that has landed, source by source in registry order, then stop.

    One source at a time, because the first of two equal records is the one of the earlier source. With ``archive``, all
    files that were taken in, those of the last batch too, are moved there at the end.
    """
    for name in registry if sources is None else sources:
        try:
            query = ingest_stream(spark, registry[name], staging, store_root, settings, checkpoint, archive=archive, **options)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        query.awaitTermination()
        if archive is not None:
            archive_taken(spark, registry[name], checkpoint, archive)
