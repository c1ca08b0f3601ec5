"""The folder that all executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a session on one machine may go without it; it then gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="docstrata-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: what several steps read is made once and outlives executors."""
    return stored_at(df)[0]


def stored_at(df: DataFrame, compression: str = "snappy") -> tuple[DataFrame, str]:
    """``stored``, and the folder to ``remove`` once nothing reads the table any more."""
    path = f"{shared_folder(df.sparkSession)}/docstrata-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextmanager
def swept(spark: SparkSession):
    """Inside, what a step has shuffled goes when the step ends, so the steps of a long job share one step's disk."""
    conf, key = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        yield
    finally:
        conf.set(key, before)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
