"""Session helpers: local sessions for tests and bench, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "tallyloom", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benches. On a cluster the session is the cluster's own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one if all runs on one machine.

    On a cluster a local folder would be another one on each executor, so an unset name is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused folder below the shared scratch root."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, *paths: str) -> None:
    """Remove folders of the shared scratch root that are no longer needed."""
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole text at once; False if it is there already. Of several writers one succeeds.

    The text is written beside it first. On a local disk a hard link then takes the name, elsewhere a rename, which a
    file system of a cluster refuses when the name is taken.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    system.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    stream = system.create(draft)
    stream.write(bytearray(text.encode()))
    stream.close()
    if system.getUri().getScheme() != "file":
        if system.rename(draft, target):
            return True
        system.delete(draft, False)
        return False
    local = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, draft)]
    try:
        jvm.java.nio.file.Files.createLink(*local)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in str(error.java_exception):
            raise
        return False
    finally:
        system.delete(draft, False)


#: A reader of positioned ranges keeps a direct buffer of the size of a column chunk in each of its threads, outside the heap, as long as
#: the executor lives; streams have none. Chunks are small, so that neither writer nor reader holds much of a wide column.
READING = {"parquet.hadoop.vectored.io.enabled": "false"}
WRITING = {"parquet.block.size": str(16 << 20)}


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back; survives the loss of any executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**WRITING).parquet(path)
    return df.sparkSession.read.options(**READING).schema(df.schema).parquet(path)
