"""Working tables in the folder that all executors share.

The folder is the cluster's ``spark.checkpoint.dir``. Where that is unset, a local
session gets a folder of its own; any other session is refused, as a machine-local
folder would lose data with its machine.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: str | None = None
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    global _local
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="sieveline-")
        atexit.register(shutil.rmtree, _local, True)
    return f"file://{_local}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: it is computed
    once, its lineage ends, and it outlives any executor. The table stays until
    ``clear``, as results read it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    _made.append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the shuffle files of this write go when it ends
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Remove all working tables made so far, once results that read them are written; their number."""
    n = len(_made)
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
