"""Streams drained over the supplied tables, and batch forms of time rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docstrata.operators import chunking
from docstrata.plans.chunk_sql import chunk_sql
from docstrata.plans.measures import LABEL, METRICS
from docstrata.plans.registry import query
from docstrata.sources import views as V
from docstrata.sources.shared import shared_folder
from docstrata.streaming import expiry, flows


def _stream(spark, d, name):
    """A table as a stream of its files."""
    table = V.read(spark, d, name)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 100).parquet(f"{d}/{name}.parquet*")


@query("st1_continuous_ingest", "SELECT doc_id, page_number, md5(text) AS text_md5 FROM v_pages", "v_pages")
def st1(spark, d):
    docs = _stream(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("project_id"), "text")
    return flows.drained(spark, flows.ingest(docs), shared_folder(spark)).select("doc_id", "page_number", F.md5("text").alias("text_md5"))


@query("st1_ingest_to_chunks", chunk_sql("SELECT CAST(min(doc_id) AS VARCHAR) AS id, text FROM documents GROUP BY text", 128, 12))
def st1_chunks(spark, d):
    """Documents as a stream: hashes, pages, chunks, merged by document."""
    docs = _stream(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("doc_id"), "text")
    out = flows.continuous_ingest(docs, f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}", size=128)
    plain = lambda c: F.regexp_replace(c, "^0+(?=[0-9])", "")
    return out.select(plain("chunk_id").alias("chunk_id"), plain("doc_id").alias("doc_id"), "page_number", "chunk_index", "text", "token_count", "is_table")


@query("st2_stream_dedup", "SELECT count(DISTINCT text) AS n FROM documents")
def st2(spark, d):
    docs = _stream(spark, d, "documents").select("doc_id", "text", F.timestamp_seconds(F.lit(1_700_000_000) + F.lit(0) * F.col("doc_id")).alias("ts"))
    return flows.drained(spark, flows.deduplicated(docs, "ts"), shared_folder(spark)).agg(F.count(F.lit(1)).alias("n"))


def _live_grades(spark, d):
    e = _stream(spark, d, "events")
    grade = F.when(F.col("event_type") != "error", F.col("value") / 500)
    return e.select((F.col("user_id") % 10).alias("project_id"), F.col("ts").cast("timestamp").alias("created_at"), grade.alias("retrieval_grade"), F.when(F.col("event_type") == "click", "RELEVANT").when(F.col("event_type") == "view", "AMBIGUOUS").alias("grade_label"), (F.col("event_type") == "purchase").alias("watcher_processed"))


@query("st3_trigger_windows", "WITH g AS (SELECT project_id, unnest([CAST(floor(epoch(created_at) / 86400) AS BIGINT) * 86400, CAST(floor(epoch(created_at) / 86400) AS BIGINT) * 86400 - 86400]) AS s, retrieval_grade, watcher_processed FROM v_grades) SELECT project_id, s AS window_start, count(*) AS recent, count(*) FILTER (WHERE retrieval_grade < 0.5 AND NOT watcher_processed) AS poor FROM g GROUP BY 1, 2", "v_grades")
def st3(spark, d):
    out = flows.drained(spark, flows.trigger_counts(_live_grades(spark, d)), shared_folder(spark), "complete")
    return out.select("project_id", F.unix_timestamp("window.start").alias("window_start"), "recent", "poor")


@query("st4_daily_metrics", f"SELECT project_id, CAST(floor(epoch(created_at) / 86400) AS BIGINT) * 86400 AS day_start, {METRICS} FROM (SELECT *, {LABEL} AS lab FROM v_grades) GROUP BY 1, 2", "v_grades")
def st4(spark, d):
    out = flows.drained(spark, flows.daily_metrics(_live_grades(spark, d)), shared_folder(spark), "complete")
    return out.select("project_id", F.unix_timestamp("window.start").alias("day_start"), "query_count", "avg_grade_score", "relevant_pct", "ambiguous_pct", "irrelevant_pct")


@query("st5_latest_progress", "SELECT user_id AS doc_id, arg_max(event_type, (ts, event_id)) AS stage, arg_max(CAST(floor(value) AS BIGINT) % 101, (ts, event_id)) AS pct FROM events GROUP BY 1")
def st5(spark, d):
    e = _stream(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("stage"), (F.floor("value") % 101).alias("pct"), "ts", "event_id")
    return flows.drained(spark, flows.latest_progress(e), shared_folder(spark), "complete")


@query("st6_expiry", "SELECT event_id FROM events WHERE NOT (event_type = 'purchase' AND ts < TIMESTAMP '2024-01-30 23:55:00')")
def st6(spark, d):
    gone = (F.col("event_type") == "purchase") & (F.col("ts") < F.expr(f"timestamp_ntz'{V.AS_OF}' - interval 300 seconds"))
    return V.read(spark, d, "events").where(~gone).select("event_id")


_OPEN = "SELECT user_id AS key, CASE CAST(event_id % 3 AS INTEGER) WHEN 0 THEN 'job' WHEN 1 THEN 'plan' ELSE 'run' END AS kind, event_type IN ('view', 'click') AS opens, epoch_us(ts) // 1000 AS ms FROM events"
_SETTLED = "2024-01-29 00:00:00"  # some hours before the last rows: the watermark has passed it when a stream has read all


@query(
    "st6_expiry_timers",
    f"WITH o AS ({_OPEN}), n AS (SELECT *, lead(ms) OVER (PARTITION BY key ORDER BY ms, opens DESC) AS following, "
    "ms + CASE kind WHEN 'job' THEN 300000 WHEN 'plan' THEN 1800000 ELSE 14400000 END AS expired_ms FROM o) "
    f"SELECT key, kind, expired_ms FROM n WHERE opens AND (following IS NULL OR following > expired_ms) AND expired_ms < epoch_ms(TIMESTAMP '{_SETTLED}')",
)
def st6_timers(spark, d):
    """Views and clicks open a job, a plan or a run of their user, other events end it; what expires is told by event-time timers."""
    e = _stream(spark, d, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "job").when(F.col("event_id") % 3 == 1, "plan").otherwise("run")
    rows = e.select(F.col("user_id").alias("key"), kind.alias("kind"), F.col("event_type").isin("view", "click").alias("opens"), F.col("ts").cast("timestamp").alias("at"))
    shards = max(64, V.read(spark, d, "events").count() // 20_000)
    with expiry.with_rocks(spark):
        out = flows.drained(spark, expiry.expiries(rows, shards=shards), shared_folder(spark))
    return out.where(F.col("expired_at") < F.lit(_SETTLED).cast("timestamp")).select("key", "kind", F.unix_millis("expired_at").alias("expired_ms"))


@query(
    "j8_stream_stream_grades",
    "WITH a AS (SELECT user_id AS key, event_id AS query_id, ts AS asked_at FROM events WHERE event_type = 'view'), "
    "g AS (SELECT user_id AS key, event_id AS grade_id, floor(value) AS grade, ts AS graded_at FROM events WHERE event_type IN ('click', 'purchase')) "
    "SELECT query_id, grade_id, CAST(grade AS BIGINT) AS grade FROM a LEFT JOIN g ON g.key = a.key AND graded_at >= asked_at AND graded_at <= asked_at + INTERVAL 12 HOUR "
    f"WHERE asked_at < TIMESTAMP '{_SETTLED}' - INTERVAL 12 HOUR",
)
def j8_streams(spark, d):
    """Views are the query log, clicks and purchases the grades that come within twelve hours, each a stream of its own."""
    at = F.col("ts").cast("timestamp")
    asked = _stream(spark, d, "events").where("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("event_id").alias("query_id"), at.alias("asked_at"))
    graded = _stream(spark, d, "events").where("event_type IN ('click', 'purchase')").select(F.col("user_id").alias("key"), F.col("event_id").alias("grade_id"), F.floor("value").alias("grade"), at.alias("graded_at"))
    out = flows.drained(spark, flows.graded_queries(asked, graded, "12 hours"), shared_folder(spark))
    return out.where(F.col("asked_at") < F.expr(f"timestamp'{_SETTLED}' - interval 12 hours")).select("query_id", "grade_id", "grade")


_SESSIONS = "WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 21600 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, count(*) AS n FROM s GROUP BY user_id, k"


@query("st7_session_windows", _SESSIONS)
def st7(spark, d):
    """As a stream."""
    events = _stream(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = flows.drained(spark, flows.activity(events, "6 hours"), shared_folder(spark), "complete")
    return out.select("user_id", F.unix_timestamp("session_window.start").alias("started"), "n")


@query("st7_session_windows_batch", _SESSIONS)
def st7_batch(spark, d):
    out = flows.activity(V.read(spark, d, "events"), "6 hours")
    return out.select("user_id", F.unix_timestamp("session_window.start").alias("started"), "n")


@query("st8_late_grades", "WITH g AS (SELECT project_id, created_at, max(created_at) OVER (ORDER BY epoch(created_at) + latency_ms * 60, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM v_grades) SELECT project_id, count(*) AS late FROM g WHERE created_at < latest - INTERVAL 2 HOUR GROUP BY 1", "v_grades")
def st8(spark, d):
    """Grades that arrive as many minutes late as their latency says: those that a watermark of two hours drops, and a later batch counts."""
    arrival = F.struct((F.unix_micros(F.col("created_at").cast("timestamp")) + F.col("latency_ms") * 60_000_000).alias("at"), "id")
    g = V.grades(spark, d).select("id", "project_id", "created_at", arrival.alias("arrival"))
    return flows.late_rows(g, "arrival", "created_at").groupBy("project_id").agg(F.count(F.lit(1)).alias("late"))


@query("f4_chunk_function", chunk_sql("SELECT id, text FROM v_documents", 64, 12).replace("SELECT chunk_id, doc_id, page_number, CAST(chunk_index AS INTEGER) AS chunk_index, text, CAST(greatest(1, length(text) // 4) AS INTEGER) AS token_count, false AS is_table FROM", "SELECT doc_id, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM") + " GROUP BY doc_id", "v_documents")
def f4(spark, d):
    """Chunking as a table function after LATERAL, a row for each chunk of each page."""
    name = chunking.register_chunk_function(spark)
    chunks = spark.sql(f"SELECT p.doc_id, c.chunk FROM {{pages}} p, LATERAL {name}(p.text, 64, 0.2D) c", pages=V.pages(spark, d).select("doc_id", "text"))
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).alias("chars"))
