"""What several operators of this subpackage need: tables in the cluster's shared folder, and connected components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.sources.shared import shared_folder


_FEW_EDGES, _MANY_EDGES = 250_000, 1_000_000  # between them, the edges of a hub are a few megabytes at most
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def table(df: DataFrame, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Write ``df`` into the shared folder and read it back: lineage ends at files that outlive any executor.

    A table that a lazy result still reads stays there; ``collected`` tells a caller that has stored the result what to delete.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docstrata-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    own = _WRITTEN.get()
    if own is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def slices(batches, column: str, most: int = 4 << 20):
    """Arrow batches cut into runs of rows whose ``column`` of strings holds about ``most`` bytes (one row at least).

    What a task holds beside its input then does not grow with the rows of a batch; Arrow's pool gives memory back after each.
    """
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            pa.default_memory_pool().release_unused()
            at = end


@contextmanager
def collected():
    """The paths of the tables that are written inside, in this thread alone, without those that are deleted again."""
    mine: list[str] = []
    token = _WRITTEN.set(mine)
    try:
        yield mine
    finally:
        _WRITTEN.reset(token)


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    own = _WRITTEN.get()
    if own is not None:
        own[:] = [x for x in own if x not in paths]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def parts(spark: SparkSession, rows: int, each: int) -> int:
    """How many parts hold ``rows`` with about ``each`` rows in one."""
    return max(1, -(-rows // max(1, each)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges`` has ``a`` and ``b`` (loops and repeats allowed). Returns ``node`` and ``comp``, the smallest node of its
    component, for each node with at least one edge to another node. Alternates large-star and small-star steps, which
    reach a forest of stars after a number of rounds that grows with the logarithm of the component's size; each round
    is an aggregate by node and a join, so no task gathers a component, and its edges go to the shared folder.
    """
    spark = edges.sparkSession

    paths = []

    def star(sym: DataFrame) -> DataFrame:
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        if seen[0] <= _FEW_EDGES:  # at most twice as many rows of two numbers: no hub meets its edges in one task
            return sym.join(F.broadcast(least), "u")
        if seen[0] > _MANY_EDGES:  # as a table, the join reads both sides from shuffles, and Spark can split the edges of a hub
            least, where = table(least)
            paths.append(where)
        return sym.join(least, "u")

    def mark(df: DataFrame):
        got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return got["n"], got["s"]

    now, path = table(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined = star(large)
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(joined.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        after, next_path = table(small)
        new = mark(after)
        forget(spark, path, *paths)
        paths.clear()
        now, path = after, next_path
        if new == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
