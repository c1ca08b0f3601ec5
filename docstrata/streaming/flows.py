"""Streaming forms of ingest, de-duplication, triggers, metrics, progress and sessions.

Each function takes a streaming (or batch) DataFrame and gives one; ``drained`` runs a stream over what is there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docstrata.operators import chunking, quality
from docstrata.sources import hash_store, tables
from docstrata.sources.shared import stored


def drained(spark: SparkSession, stream: DataFrame, folder: str, mode: str = "append", name: str | None = None) -> DataFrame:
    """Everything a stream makes of its present input, as a table in ``folder``; ``complete`` keeps the last batch.

    Each batch has a folder of its own under its number, so a batch that is run again replaces what it wrote before. With
    the same ``name`` a later call goes on where an earlier one ended, its state included.
    """
    name = name or uuid.uuid4().hex
    out, state = f"{folder}/out-{name}", f"{folder}/state-{name}"

    def write(batch: DataFrame, number: int):
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    run = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def ingest(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, project_id, text) to pages as they come."""
    return chunking.virtual_pages(docs)


_FILES, _CHUNKS = "doc_id string, file_hash string", "chunk_id string, doc_id string, page_number int, chunk_index int, text string, token_count int, is_table boolean"


def ingest_batch(batch: DataFrame, number: int, folder: str, *, size: int = 512, overlap: float = 0.1) -> None:
    """One batch of documents (doc_id, text) into the tables ``files`` and ``chunks`` of ``folder``.

    A content hash that the batch or an earlier batch has already is left out (a ``hash_store`` knows them, so the cost of a
    batch does not grow with the history; compact it now and then); the rest is paged and chunked (null texts
    count as empty). Both tables
    are written under the batch's number, so a batch that is run again replaces its own rows and never doubles them. A
    document that comes again with other content gets a new set of chunks; ``current`` reads the newest.
    """
    spark = batch.sparkSession
    hashed = tables.content_hash(batch.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text")
    first = hashed.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"))
    new = stored(first.join(hash_store.add(spark, f"{folder}/hashes", first, number), "file_hash", "left_semi"))
    # one id for each hash is left, so the rows need no other partitioning than the join's to be told apart
    fresh = hashed.join(new, ["file_hash", "doc_id"], "left_semi").dropDuplicates(["file_hash", "doc_id"])
    chunks = chunking.chunk_pages(chunking.virtual_pages(fresh.select("doc_id", "text")), size=size, overlap=overlap)
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks/batch={number}")
    new.select("doc_id", "file_hash").where("doc_id is not null").write.mode("overwrite").parquet(f"{folder}/files/batch={number}")


def _of_batches(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/{name}")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of each document's newest batch."""
    files, chunks = _of_batches(spark, folder, "files", _FILES), _of_batches(spark, folder, "chunks", _CHUNKS)
    newest = files.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return chunks.join(newest, ["doc_id", "batch"], "left_semi").drop("batch")


def continuous_ingest(docs: DataFrame, folder: str, **how) -> DataFrame:
    """Drains a stream of documents (doc_id, text) into chunks: pages, chunks, hash de-duplication and merge by document."""
    run = docs.writeStream.foreachBatch(lambda batch, number: ingest_batch(batch, number, folder, **how))
    run.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return current(docs.sparkSession, folder)


def late_rows(rows: DataFrame, order: str, time_col: str, delay: str = "2 hours", strip_rows: int = 100_000) -> DataFrame:
    """Rows that a watermark of ``delay`` would drop if rows came one by one by ``order`` (unique): older than the latest
    time before them by more than the delay.

    Rows are dealt to ranges of ``order``; the latest time before a range comes from a table with a row for each range.
    """
    cuts = max(1, -(-rows.count() // strip_rows))
    dealt = stored(rows.repartitionByRange(cuts, order).withColumn("__strip", F.spark_partition_id()))
    strips = dealt.groupBy("__strip").agg(F.max(time_col).alias("__most"))
    earlier = strips.withColumn("__before", F.max("__most").over(Window.orderBy("__strip").rowsBetween(Window.unboundedPreceding, -1))).drop("__most")
    inside = F.max(time_col).over(Window.partitionBy("__strip").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    seen = dealt.withColumn("__inside", inside).join(earlier, "__strip").withColumn("__latest", F.greatest("__inside", "__before"))
    return seen.where(F.col(time_col) < F.col("__latest") - F.expr(f"interval {delay}")).select(*rows.columns)


def deduplicated(docs: DataFrame, time_col: str, delay: str = "2 hours") -> DataFrame:
    """The first row of each content hash within the watermark."""
    hashed = docs.withColumn("file_hash", F.sha2(F.col("text").cast("binary"), 256))
    return hashed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["file_hash"])


def trigger_counts(grades: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Rows and poor rows of each project in sliding windows of 48 hours."""
    w = F.window("created_at", "48 hours", "24 hours")
    poor = (F.col("retrieval_grade") < 0.5) & ~F.col("watcher_processed")
    return grades.withWatermark("created_at", delay).groupBy("project_id", w).agg(F.count(F.lit(1)).alias("recent"), F.count_if(poor).alias("poor"))


def daily_metrics(grades: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Grade metrics of each project and day."""
    return quality.metrics(grades.withWatermark("created_at", delay), "project_id", F.window("created_at", "1 day"))


def latest_progress(events: DataFrame) -> DataFrame:
    """The last stage and percentage of each document."""
    last = F.max_by(F.struct("stage", "pct"), F.struct("ts", "event_id"))
    return events.groupBy("doc_id").agg(last.alias("last")).select("doc_id", "last.stage", "last.pct")


def activity(messages: DataFrame, gap: str, delay: str = "2 hours") -> DataFrame:
    """Sessions of each user: rows between gaps of inactivity."""
    w = F.session_window("ts", gap)
    return messages.withWatermark("ts", delay).groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n"))


def graded_queries(asked: DataFrame, graded: DataFrame, within: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Logged queries with the grades that come later: one stream joined with another.

    ``asked`` has ``key``, ``query_id``, ``asked_at``; ``graded`` has ``key``, ``grade_id``, ``grade``, ``graded_at``. A grade belongs to a query of the same key
    that was asked at its time or up to ``within`` before. A query without any is given once, with nulls, when the watermarks of both
    streams leave no room for one; until then queries and grades wait in the state, and are dropped from it after.
    """
    left = asked.select("key", "query_id", "asked_at").withWatermark("asked_at", delay)
    right = graded.select(F.col("key").alias("graded_key"), "grade_id", "grade", "graded_at").withWatermark("graded_at", delay)
    meets = (F.col("key") == F.col("graded_key")) & (F.col("graded_at") >= F.col("asked_at")) & (F.col("graded_at") <= F.col("asked_at") + F.expr(f"interval {within}"))
    return left.join(right, meets, "leftOuter").drop("graded_key")
