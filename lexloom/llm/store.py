"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Most rows and bytes that the JVM sends to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Limits the session's Arrow batches, so that texts of any length fit in a worker's memory."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, most)


def trim() -> None:
    """Gives memory that is free inside this process back to the machine."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def freed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function after which an idle Python worker keeps no memory of its last task."""

    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, in local mode, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lexloom-")
    return _own[app]


#: Whether Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, passing: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, so a lost executor costs no rerun of what came before.

    With ``passing``, what was shuffled for it is removed when it is written,
    not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if passing:
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, True)
        try:
            df.write.parquet(path)
        finally:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    name, taken = f"_{name}", {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column name of ``df`` has."""
    prefix = "_own_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def drop(df: DataFrame) -> None:
    """Removes the files of a table that :func:`written` made and nothing needs any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if parent.startswith(shared_dir(spark).replace("file:///", "file:/")) or parent.startswith(shared_dir(spark)):
            at = jvm.org.apache.hadoop.fs.Path(parent)
            at.getFileSystem(conf).delete(at, True)


def bounded_broadcast(spark: SparkSession, value, size: int, most: int):
    """Broadcasts ``value`` after a check that its ``size`` in bytes is at most ``most``."""
    small_batches(spark)
    if size > most:
        raise ValueError(f"{size} bytes are too many to broadcast (at most {most})")
    return spark.sparkContext.broadcast(value)
