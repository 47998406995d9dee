"""Scratch tables in the folder that spark.checkpoint.dir names, which all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """This session's folder below spark.checkpoint.dir; a temporary one only for a local master, as in tests. A cluster must name one that all share."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = base or tempfile.mkdtemp(prefix="skein-")
        _roots[app] = f"{base.rstrip('/')}/skein-{uuid.uuid4().hex}"
        atexit.register(_at_exit, spark, _roots[app])
    return _roots[app]


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of any store; works after the session was stopped, too."""
    context = spark.sparkContext
    jvm = context._jvm
    conf = context._jsc.hadoopConfiguration() if context._jsc is not None else jvm.org.apache.hadoop.conf.Configuration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Py4JError, OSError, AttributeError):  # the engine may be gone by now; then its host clears the folder
        drop_path(spark, path)


class Stored:
    """A written table: `df` reads it, `drop()` deletes its files once nothing reads them any more."""

    def __init__(self, spark: SparkSession, path: str, df: DataFrame):
        self.spark, self.path, self.df = spark, path, df

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def store(df: DataFrame) -> Stored:
    """Write df below the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return Stored(spark, path, spark.read.schema(df.schema).parquet(path))
