"""The folder that driver and executors share, and tables in it that cut lineage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting for the bytes of an Arrow batch, its default, and what is small enough for a worker.
SIZE, DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"
#: Tables that a worker keeps from task to task, by the module that owns them.
KEPT: dict[str, object] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _tidy(owner: str) -> None:
    for other in [k for k in KEPT if k != owner]:
        del KEPT[other]
    give_back()


def _tidied(run: Callable[..., Iterator], batches: Iterator) -> Iterator:
    _tidy(run.__module__)
    try:
        yield from run(batches)
    finally:
        _tidy(run.__module__)


def lean(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``run`` for ``mapInArrow`` in a reused worker: what other operators kept there goes first, and freed memory is given back to the
    system when the task ends. The session's Arrow batches are held to ``BATCH``, unless it has set a size of its own."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(SIZE) == DEFAULT:
        spark.conf.set(SIZE, BATCH)

    def task(batches):
        return _tidied(run, batches)

    return task


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session without one (tests) gets a temporary folder."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(columns: list[str], base: str) -> str:
    """``base``, or with as many underscores as no column (whatever its case) has."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def with_key(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a unique long ``key`` that is in the order of doc_id (nulls first), then text: doc_id itself if it is a key,
    else a number of the row (stored)."""
    odd = docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count()
    if not odd:
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    return stored(docs.orderBy("doc_id", "text").withColumn(key, F.monotonically_increasing_id()), "ordered")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
