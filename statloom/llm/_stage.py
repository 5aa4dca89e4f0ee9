"""Places where a job cuts its lineage, and the settings that go with it."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"
#: Bytes of one Arrow batch of texts, which a task holds several times, in the JVM and in Python.
BATCH_BYTES = 4 << 20
#: Narrow rows of one file, where their number is known.
FILE_ROWS = 100_000
#: Written tables need no checksum files on a local disk: there each file, and each file of checksums, starts a
#: process for its permissions, which shares the executor's memory until it runs.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where none is set and Spark runs in one process, as in tests."""
    found = spark.sparkContext.getConf().get(_DIR) or spark.conf.get(_DIR, None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isDefined():
            return jsc.getCheckpointDir().get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_DIR} to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="statloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` narrow rows in few partitions, so that what is written of them has few files."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def written(df: DataFrame, name: str, rows: int | None = None, narrow: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: no shuffle is repeated for it.

    ``rows``, about the number of narrow rows, keeps a small table from many files.  ``narrow``: their number is not
    known before; many tasks make them, a shuffle without a key brings them into few files.
    """
    spark = df.sparkSession
    if rows is not None:
        df = in_few(df, rows)
    elif narrow:
        df = df.repartition(2 * spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with tidy_shuffles(spark):
        df.write.options(compression="zstd", **_PLAIN).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_BYTES`` (or one longer row), unless it has a limit of its own.

    The setting stays: plans read it when they run.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if key not in spark.conf.getAll:
            spark.conf.set(key, str(BATCH_BYTES))
    except Exception:  # noqa: BLE001  an older Spark without the setting works as well
        return


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """Let Spark drop the shuffle files of an execution as soon as it has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "true")
    except Exception:  # noqa: BLE001  an older Spark without the setting works as well
        yield
        return
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
