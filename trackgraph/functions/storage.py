"""Tables written to the shared folder of the cluster, to cut lineage in loops and to reuse results."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset (tests on one machine) a temporary folder is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Folders written inside the innermost :func:`scratch`; each thread has its own.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables staged inside are removed at the end; gives a form of :func:`staged` for results, whose tables stay."""
    outer, own = _SCRATCH.get(), []

    def kept(df: DataFrame, name: str) -> DataFrame:
        token = _SCRATCH.set(outer)
        try:
            return staged(df, name)
        finally:
            _SCRATCH.reset(token)

    token = _SCRATCH.set(own)
    try:
        yield kept
    finally:
        _SCRATCH.reset(token)
        _remove(spark, own)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: computed once, short lineage, survives lost executors.

    Then the driver collects its garbage: its heap stays near what is in use, and Spark's cleaner drops the shuffles and broadcasts
    of tables that are gone, which it learns of by collections only. Python's comes first, for its objects hold plans and broadcasts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCRATCH.get() is not None:
        _SCRATCH.get().append(path)
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)
