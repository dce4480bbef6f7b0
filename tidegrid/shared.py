"""Session helpers: the folder all executors share, written tables, the workers' import path."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from the place where the driver found it, and sets the session's zone:
    all times of the tables are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where the setting is absent (a local session, as in tests) a
    temporary folder is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tidegrid-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Bytes per core below which files can't be split finely enough to keep all cores busy.
SPLIT = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is so small that its files make fewer tasks than there are cores; else as it is, so
    a large input isn't moved. For work that costs far more than moving a row. Rows are the same either way; where the
    engine's estimate can't be had (as over a remote connection), ``df`` stays as it is."""
    if df.isStreaming:
        return df
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except (AttributeError, NotImplementedError, PySparkException):
        return df
    return df.repartition(cores) if size < cores * SPLIT else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: computed once, lineage cut, and safe when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_path(spark, name)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
