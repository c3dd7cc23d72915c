"""Scratch tables in the folder that driver and executors share, to cut lineage in a way that survives lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of sessions that name none, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder if driver and executors are one machine, else an error, as
    executors would write to disks that nobody else sees."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            own = _own[context.applicationId] = tempfile.mkdtemp(prefix="twinloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = _own[context.applicationId]
    return found


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/twinloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_home(spark)}/{name}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application; results that were not written elsewhere can't be read any more."""
    home = spark._jvm.org.apache.hadoop.fs.Path(_home(spark))
    home.getFileSystem(spark._jsc.hadoopConfiguration()).delete(home, True)


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more."""
    if path := getattr(df, "scratch_path", None):
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
