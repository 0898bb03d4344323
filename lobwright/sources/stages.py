"""Stage tables.  The long chain is cut by writing a stage as parquet in the cluster's checkpoint folder.

A stage written there is columnar, so later queries read only the columns they use, and it survives the loss of any
executor.  The folder is ``spark.checkpoint.dir`` of the session; where that is unset (tests, one machine) a new
temporary folder is used.
"""

from __future__ import annotations

import contextlib
import itertools
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: dict[tuple[str, str, str], tuple] = {}
_counter = itertools.count()
_local_root: list[str] = []
_scopes: list[list[str]] = []


def checkpoint_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="spark-lobwright-"))
    return _local_root[0]


def forget_stages() -> None:
    """The next use of a stage writes it anew."""
    _written.clear()


def new_path(spark: SparkSession, name: str) -> str:
    """A folder in the checkpoint folder that nothing else uses."""
    folder = f"{next(_counter):05d}-{os.urandom(4).hex()}-{name}"
    path = os.path.join(checkpoint_root(spark), "lobwright", spark.sparkContext.applicationId, folder)
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that ``cut`` and ``per_key`` write inside the block are deleted at its end, when their readers are done."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The same rows, read back from a written table: what lies above it runs once, however often it is used."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_key(df: DataFrame) -> DataFrame:
    """A table of one row per symbol or the like, written once so that its true size is known before it is joined.

    An aggregate's size is only guessed at planning time, and a join with it would shuffle the big side first.  Over
    the written table Spark compares the real size with ``autoBroadcastJoinThreshold``: below it the table is
    broadcast, above it the join is a shuffle join.
    """
    return cut(df, "per_key")


def stage(spark: SparkSession, scope: str, name: str, build) -> DataFrame:
    """Reads stage ``name`` of input ``scope``, writing it first if this session has not."""
    key = (spark.sparkContext.applicationId, scope, name)
    if key not in _written:
        df = build()
        path = new_path(spark, name)
        df.write.parquet(path)
        _written[key] = (path, df.schema)
    path, schema = _written[key]
    return spark.read.schema(schema).parquet(path)
