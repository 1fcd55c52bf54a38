"""Tables written between steps.

A staged table cuts lineage and is read again by several later steps. It lies in the shared folder that the
cluster names in ``spark.checkpoint.dir``, so the loss of an executor loses no part of it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables: ``spark.checkpoint.dir`` of the session; only where it is unset (tests,
    local runs) a temporary folder, which is then set for the session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-pairloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below :func:`shared_dir` and return it as read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairloom/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged within the block are deleted at its end: for work that has written its results by then. Elsewhere
    they stay until the shared folder is cleared, as the DataFrames made of them may be read at any time."""
    before = len(_STAGED)
    try:
        yield
    finally:
        while len(_STAGED) > before:
            path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, least: int = 4 << 20) -> DataFrame:
    """A small table over all cores. A file of one row group is read by one task, however much work follows; below
    ``least`` bytes a core moving the rows costs less than that. Larger tables are left as they are scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < least * cores else df


def tasks(spark: SparkSession) -> int:
    """Number of shuffle tasks the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
