"""Tables in the shared folder that cut lineage, so that a lost executor's work is read again and never drawn anew."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules["trailspark"])

_local_base: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for cut lineage; a folder of our own only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + _local_base.setdefault("dir", tempfile.mkdtemp(prefix="trailspark-"))


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/trailspark/{uuid.uuid4().hex}/{tag}"
    _written.append(path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write ``df`` once as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trailspark_path = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _written:
        _written.remove(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table of ``materialise`` once nothing reads it any more."""
    delete_path(df.sparkSession, df._trailspark_path)


def release(spark: SparkSession) -> None:
    """Delete every table this process wrote; call it when all results have been consumed."""
    for path in list(_written):
        delete_path(spark, path)
