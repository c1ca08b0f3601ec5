"""Quality of retrieval, triggers, runs, clusters and sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docstrata.functions import text as T
from docstrata.operators import quality, sessions, vectors
from docstrata.plans.registry import query
from docstrata.sources import views as V

LABEL = "coalesce(nullif(grade_label, ''), CASE WHEN coalesce(nullif(retrieval_grade, 0), 0.5) >= 0.7 THEN 'RELEVANT' WHEN coalesce(nullif(retrieval_grade, 0), 0.5) >= 0.4 THEN 'AMBIGUOUS' ELSE 'IRRELEVANT' END)"
METRICS = (
    "count(*) AS query_count, round(avg(coalesce(nullif(retrieval_grade, 0), 0.5)), 4) AS avg_grade_score, round(count(*) FILTER (WHERE lab = 'RELEVANT') / count(*), 4) AS relevant_pct, "
    "round(count(*) FILTER (WHERE lab = 'AMBIGUOUS') / count(*), 4) AS ambiguous_pct, round(count(*) FILTER (WHERE lab = 'IRRELEVANT') / count(*), 4) AS irrelevant_pct"
)


@query("a1_documents_per_project", "SELECT p.n_name AS project_id, count(d.doc_id) AS doc_count FROM nation p LEFT JOIN documents d ON d.source = 'src' || p.n_nationkey GROUP BY 1")
def a1(spark, d):
    counts = V.read(spark, d, "documents").groupBy("source").agg(F.count("doc_id").alias("doc_count"))
    n = V.read(spark, d, "nation").select(F.col("n_name").alias("project_id"), F.concat(F.lit("src"), "n_nationkey").alias("source"))
    return n.join(counts, "source", "left").select("project_id", F.coalesce("doc_count", F.lit(0)).alias("doc_count"))


@query("a2_quality_panel", "SELECT project_id, count(*) AS total, round(avg(retrieval_grade), 6) AS avg_grade, round(avg(latency_ms), 6) AS avg_latency, count(*) FILTER (WHERE retrieval_grade < 0.5) AS poor, count(*) FILTER (WHERE NOT watcher_processed) AS unprocessed FROM v_grades GROUP BY 1", "v_grades")
def a2(spark, d):
    return quality.panel(V.grades(spark, d))


@query("a3_grade_metrics", f"SELECT project_id, {METRICS} FROM (SELECT *, {LABEL} AS lab FROM v_grades WHERE created_at >= TIMESTAMP '2024-01-24' AND created_at <= TIMESTAMP '2024-01-31') GROUP BY 1", "v_grades")
def a3(spark, d):
    g = V.grades(spark, d).where(f"created_at >= timestamp_ntz'{V.AS_OF}' - interval 7 days and created_at <= timestamp_ntz'{V.AS_OF}'")
    return quality.metrics(g, "project_id")


@query("a4_improvement", f"WITH m AS (SELECT project_id, created_at > TIMESTAMP '2024-01-15' AS post, {METRICS} FROM (SELECT *, {LABEL} AS lab FROM v_grades) GROUP BY 1, 2) SELECT a.project_id, round(b.avg_grade_score - a.avg_grade_score, 4) AS grade_change, round(b.relevant_pct - a.relevant_pct, 4) AS relevant_change, round(a.irrelevant_pct - b.irrelevant_pct, 4) AS irrelevant_fall FROM m a JOIN m b ON a.project_id = b.project_id AND NOT a.post AND b.post", "v_grades")
def a4(spark, d):
    return quality.improvement(V.grades(spark, d), "2024-01-15 00:00:00")


@query("a5_triggers", "SELECT project_id, count(*) FILTER (WHERE retrieval_grade < 0.5 AND NOT watcher_processed) AS poor, count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-29' AND created_at <= TIMESTAMP '2024-01-31') AS recent, count(*) FILTER (WHERE retrieval_grade < 0.5 AND NOT watcher_processed) >= 20 OR count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-29' AND created_at <= TIMESTAMP '2024-01-31') >= 20 AS triggered FROM v_grades GROUP BY 1", "v_grades")
def a5(spark, d):
    return quality.triggers(V.grades(spark, d), V.AS_OF)


@query("a6_embedding_consistency", "WITH c AS (SELECT label % 3 AS provider, label AS model, count(*) AS n FROM embeddings GROUP BY 1, 2) SELECT count_mismatch, arg_max(provider, (n, -model)) AS provider, arg_max(model, (n, -model)) AS model FROM c CROSS JOIN (SELECT count(*) AS count_mismatch FROM embeddings WHERE label <> 0) WHERE model <> 0 GROUP BY 1")
def a6(spark, d):
    c = V.read(spark, d, "embeddings").where("label <> 0").groupBy((F.col("label") % 3).alias("provider"), F.col("label").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.sum("n").alias("count_mismatch"), F.max_by("provider", F.struct("n", -F.col("model"))).alias("provider"), F.max_by("model", F.struct("n", -F.col("model"))).alias("model"))


@query("a7_version_counts", "SELECT document_id, count(*) AS version_count FROM v_versions GROUP BY 1", "v_versions")
def a7(spark, d):
    return V.versions(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("version_count"))


@query("a8_session_totals", "SELECT session_id, count(*) AS message_count, CAST(sum(token_count) AS BIGINT) AS total_tokens, max(pos) AS last_pos FROM v_messages GROUP BY 1", "v_messages")
def a8(spark, d):
    return sessions.totals(V.messages(spark, d))


@query("a10_storage_stats", "SELECT 'documents' AS what, count(*) AS n FROM documents UNION ALL SELECT 'sessions', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'bytes', CAST(sum(n_chars) AS BIGINT) FROM documents")
def a10(spark, d):
    docs = V.read(spark, d, "documents")
    one = lambda df, what, n: df.agg(n.cast("long").alias("n")).select(F.lit(what).alias("what"), "n")
    out = one(docs, "documents", F.count(F.lit(1))).unionByName(one(V.read(spark, d, "conversations"), "sessions", F.count_distinct("conv_id")))
    return out.unionByName(one(V.read(spark, d, "embeddings"), "vectors", F.count(F.lit(1)))).unionByName(one(docs, "bytes", F.sum("n_chars")))


@query("a14_source_files", "SELECT k, array_to_string(list_sort(list_distinct(list(project_id))), ',') AS files FROM (SELECT k, CAST(project_id AS VARCHAR) AS project_id, row_number() OVER (PARTITION BY k ORDER BY id) AS r FROM v_grades) WHERE r <= 10 GROUP BY k", "v_grades")
def a14(spark, d):
    g = V.grades(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("id"))).where("r <= 10")
    return g.groupBy("k").agg(F.array_join(F.sort_array(F.collect_set(F.col("project_id").cast("string"))), ",").alias("files"))


@query("a15_word_counts", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM documents")
def a15(spark, d):
    return V.read(spark, d, "documents").select("doc_id", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long").alias("words"))


@query("a16_active_projects", "SELECT DISTINCT project_id FROM v_grades WHERE NOT watcher_processed", "v_grades")
def a16(spark, d):
    return V.grades(spark, d).where("not watcher_processed").select("project_id").distinct()


@query("t7_newest_unprocessed", "SELECT project_id, id, CAST(rn AS INTEGER) AS rn FROM (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS rn FROM v_grades WHERE NOT watcher_processed) WHERE rn <= 100", "v_grades")
def t7(spark, d):
    return quality.newest(V.grades(spark, d).where("not watcher_processed"), "project_id", "created_at", 100).select("project_id", "id", "rn")


@query("w2_latest_run", "SELECT session_id, id FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id) AS rn FROM v_grades) WHERE rn = 1", "v_grades")
def w2(spark, d):
    return quality.newest(V.grades(spark, d), "session_id", "created_at", 1).select("session_id", "id")


@query("w10_last_metrics", f"WITH m AS (SELECT project_id, CAST(created_at AS DATE) AS day, {METRICS} FROM (SELECT *, {LABEL} AS lab FROM v_grades) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY day DESC) AS rn FROM m) SELECT project_id, strftime(day, '%Y-%m-%d') AS day, query_count, avg_grade_score FROM r WHERE rn <= 10", "v_grades")
def w10(spark, d):
    daily = quality.metrics(V.grades(spark, d), "project_id", F.to_date("created_at").alias("day"))
    return quality.newest(daily, "project_id", "day", 10, "query_count").select("project_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "query_count", "avg_grade_score")


@query("p9_unprocessed", "SELECT id FROM v_grades WHERE NOT watcher_processed AND project_id IS NOT NULL", "v_grades")
def p9(spark, d):
    return V.grades(spark, d).where("not watcher_processed and project_id is not null").select("id")


@query("p8_plan_validity", "SELECT event_id AS plan_id, CASE WHEN event_type = 'error' THEN 'rejected' WHEN epoch(ts) + 1800 < epoch(TIMESTAMP '2024-01-15') THEN 'expired' ELSE 'ok' END AS state FROM events")
def p8(spark, d):
    limit = F.unix_timestamp(F.lit("2024-01-15 00:00:00").cast("timestamp"))
    state = F.when(F.col("event_type") == "error", "rejected").when(F.unix_timestamp("ts") + 1800 < limit, "expired").otherwise("ok")
    return V.read(spark, d, "events").select(F.col("event_id").alias("plan_id"), state.alias("state"))


@query("p11_stale_runs", "SELECT event_id AS run_id, CASE WHEN event_type = 'purchase' THEN 'done' WHEN ts < TIMESTAMP '2024-01-30 20:00:00' THEN 'failed' ELSE 'running' END AS status FROM events")
def p11(spark, d):
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("ts") < F.expr(f"timestamp_ntz'{V.AS_OF}' - interval 4 hours"), "failed").otherwise("running")
    return V.read(spark, d, "events").select(F.col("event_id").alias("run_id"), status.alias("status"))


@query("j8_grades_after_run", "WITH r AS (SELECT project_id, min(created_at) FILTER (WHERE watcher_processed) AS started FROM v_grades GROUP BY 1) SELECT g.project_id, count(*) AS n FROM v_grades g JOIN r ON g.project_id = r.project_id AND g.created_at > r.started GROUP BY 1", "v_grades")
def j8(spark, d):
    """A project's run starts with its first processed grade."""
    g = V.grades(spark, d).select("project_id", "created_at", "watcher_processed")
    runs = g.groupBy("project_id").agg(F.min(F.when(F.col("watcher_processed"), F.col("created_at"))).alias("started"))
    return g.join(runs, "project_id").where("created_at > started").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@query("j13_latest_run_and_metrics", "SELECT p.n_nationkey AS project_id, max(g.id) AS last_id, count(g.id) AS n FROM nation p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS rn FROM v_grades) WHERE rn <= 10) g ON g.project_id = p.n_nationkey GROUP BY 1", "v_grades")
def j13(spark, d):
    last = quality.newest(V.grades(spark, d), "project_id", "created_at", 10).groupBy("project_id").agg(F.max("id").alias("last_id"), F.count("id").alias("n"))
    return V.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("project_id")).join(last, "project_id", "left").select("project_id", "last_id", F.coalesce("n", F.lit(0)).alias("n"))


def _labelled_vectors(spark, d):
    return V.vectors(spark, d).select("project_id", F.col("chunk_no").alias("id"), "embedding")


@query("v9_near_pairs", "SELECT a.project_id, a.chunk_no AS a, b.chunk_no AS b, round(list_inner_product(a.embedding, b.embedding) / (sqrt(list_inner_product(a.embedding, a.embedding)) * sqrt(list_inner_product(b.embedding, b.embedding))), 6) AS score FROM v_vectors a JOIN v_vectors b ON a.project_id = b.project_id AND a.chunk_no < b.chunk_no WHERE round(list_inner_product(a.embedding, b.embedding) / (sqrt(list_inner_product(a.embedding, a.embedding)) * sqrt(list_inner_product(b.embedding, b.embedding))), 6) >= 0.8", "v_vectors")
def v9(spark, d):
    return vectors.near_pairs(_labelled_vectors(spark, d), 0.8)


@query("v9_near_pairs_at_03", "SELECT a.project_id, a.chunk_no AS a, b.chunk_no AS b, round(list_inner_product(a.embedding, b.embedding) / (sqrt(list_inner_product(a.embedding, a.embedding)) * sqrt(list_inner_product(b.embedding, b.embedding))), 6) AS score FROM v_vectors a JOIN v_vectors b ON a.project_id = b.project_id AND a.chunk_no < b.chunk_no WHERE round(list_inner_product(a.embedding, b.embedding) / (sqrt(list_inner_product(a.embedding, a.embedding)) * sqrt(list_inner_product(b.embedding, b.embedding))), 6) >= 0.3", "v_vectors")
def v9_low(spark, d):
    """At a cosine that random vectors reach, so that there are pairs in every table."""
    return vectors.near_pairs(_labelled_vectors(spark, d), 0.3)


_LEADERS = (
    "nw AS (SELECT project_id, chunk_no AS id, list_transform(embedding, lambda x: x / sqrt(list_inner_product(embedding, embedding))) AS u FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY chunk_no DESC) AS rn FROM v_vectors) WHERE rn <= 100), "
    "ls AS (SELECT project_id, list(id ORDER BY id) AS ids, list(u ORDER BY id) AS us, count(*) AS n FROM nw GROUP BY 1), "
    "ld AS (SELECT project_id, CAST(0 AS BIGINT) AS i, list_transform(ids, lambda x: CAST(NULL AS BIGINT)) AS lead FROM ls UNION ALL SELECT d.project_id, d.i + 1, CASE WHEN d.lead[d.i + 1] IS NOT NULL THEN d.lead ELSE list_transform(range(1, l.n + 1), lambda j: "
    "CASE WHEN d.lead[j] IS NULL AND j >= d.i + 1 AND (j = d.i + 1 OR list_inner_product(l.us[d.i + 1], l.us[j]) >= 0.8 - 1e-12) THEN d.i + 1 ELSE d.lead[j] END) END FROM ld d JOIN ls l ON l.project_id = d.project_id WHERE d.i < l.n), "
    "cl AS (SELECT d.project_id, unnest(l.ids) AS id, unnest(list_transform(d.lead, lambda k: l.ids[k])) AS leader_id FROM ld d JOIN ls l ON l.project_id = d.project_id WHERE d.i = l.n)"
)


@query("v9_leader_clusters", f"WITH RECURSIVE {_LEADERS} SELECT project_id, id, leader_id FROM cl", "v_vectors")
def v9l(spark, d):
    newest = quality.newest(_labelled_vectors(spark, d), "project_id", "id", 100).select("project_id", "id", "embedding")
    return quality.leader_clusters(newest)


@query("a12_cluster_aggregates", f"WITH RECURSIVE {_LEADERS} SELECT project_id, leader_id, count(*) AS members, min(id) AS first_id FROM cl GROUP BY 1, 2", "v_vectors")
def a12(spark, d):
    clusters = v9l(spark, d)
    return clusters.groupBy("project_id", "leader_id").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first_id"))


@query("r17_grade_parsing", "WITH r AS (SELECT event_id, CASE event_type WHEN 'click' THEN ' relevant ' WHEN 'view' THEN 'Irrelevant' WHEN 'purchase' THEN 'WRONG' ELSE 'ambiguous' END || CASE WHEN CAST(floor(value) AS BIGINT) % 7 = 0 THEN '' WHEN event_type = 'error' THEN '|x|' || props ELSE '| 0.' || lpad(CAST(CAST(floor(value) AS BIGINT) % 100 AS VARCHAR), 2, '0') || ' | ' || props || '|more' END AS t FROM events), "
       "p AS (SELECT event_id, string_split(trim(t), '|') AS p FROM r), q AS (SELECT event_id, upper(trim(p[1])) AS n, CASE WHEN len(p) > 1 THEN try_cast(trim(p[2]) AS DOUBLE) ELSE 0.5 END AS s, CASE WHEN len(p) > 2 THEN trim(array_to_string(p[3:], '|')) ELSE '' END AS why FROM p) "
       "SELECT event_id, CASE WHEN s IS NULL THEN 'RELEVANT' WHEN n IN ('RELEVANT', 'AMBIGUOUS', 'IRRELEVANT') THEN n ELSE 'AMBIGUOUS' END AS label, coalesce(s, 0.5) AS grade, CASE WHEN s IS NULL THEN '' ELSE why END AS reason FROM q")
def r17(spark, d):
    """Responses made of an event's type, value and properties; some without a score, some with one that is no number."""
    kind, whole = F.col("event_type"), F.floor("value")
    name = F.when(kind == "click", " relevant ").when(kind == "view", "Irrelevant").when(kind == "purchase", "WRONG").otherwise("ambiguous")
    score = F.concat(F.lit("| 0."), F.lpad((whole % 100).cast("string"), 2, "0"), F.lit(" | "), "props", F.lit("|more"))
    rest = F.when(whole % 7 == 0, "").when(kind == "error", F.concat(F.lit("|x|"), "props")).otherwise(score)
    return V.read(spark, d, "events").select("event_id", quality.grade_parts(F.concat(name, rest)).alias("g")).select("event_id", "g.*")


@query("c2_context_status", "WITH u AS (SELECT session_id, CAST(sum(token_count + 4) AS BIGINT) AS used_tokens, CASE session_id % 3 WHEN 0 THEN 8192 WHEN 1 THEN 32768 ELSE 128000 END AS total_tokens FROM v_messages GROUP BY 1) SELECT session_id, used_tokens, total_tokens, greatest(0, total_tokens - used_tokens) AS remaining_tokens, used_tokens / total_tokens >= 0.68 OR total_tokens - used_tokens < 32000 AS should_warn, used_tokens / total_tokens >= 0.88 OR total_tokens - used_tokens < 16000 AS should_block FROM u", "v_messages")
def c2(spark, d):
    model = F.element_at(F.array(*map(F.lit, ("Llama3:8b", "unknown", "openai/GPT-4o-mini"))), (F.col("session_id") % 3 + 1).cast("int"))
    return sessions.context_status(V.messages(spark, d), sessions.context_size(model))


_SPLIT = "m AS (SELECT *, count(*) FILTER (WHERE role <> 'system') OVER (PARTITION BY session_id) AS n, count(*) FILTER (WHERE role <> 'system') OVER (PARTITION BY session_id ORDER BY pos) AS i FROM v_messages), p AS (SELECT *, CASE WHEN role = 'system' THEN 'system' WHEN n > 4 AND i <= greatest(2, floor(n * 0.6)) THEN 'old' ELSE 'recent' END AS part FROM m)"


@query("w9_old_recent_split", f"WITH {_SPLIT} SELECT session_id, pos, part FROM p", "v_messages")
def w9(spark, d):
    return sessions.split_for_compaction(V.messages(spark, d)).select("session_id", "pos", "part")


@query("c3_compaction_decision", f"WITH {_SPLIT} SELECT session_id, count(*) FILTER (WHERE part = 'old') > 0 AS compacts FROM p GROUP BY 1", "v_messages")
def c3(spark, d):
    return sessions.split_for_compaction(V.messages(spark, d)).groupBy("session_id").agg((F.count_if(F.col("part") == "old") > 0).alias("compacts"))


@query("c4_compaction_rewrite", f"WITH {_SPLIT} SELECT session_id, pos, role, md5(content) AS digest, false AS compacted FROM p WHERE part <> 'old' UNION ALL SELECT session_id, max(pos), 'system', md5('[Conversation Summary]' || chr(10) || chr(10) || 'summary ' || session_id), true FROM p WHERE part = 'old' GROUP BY session_id", "v_messages")
def c4(spark, d):
    m = V.messages(spark, d)
    summaries = m.select("session_id").distinct().withColumn("summary", F.concat(F.lit("summary "), "session_id"))
    return sessions.compacted(m, summaries).select("session_id", "pos", "role", F.md5("content").alias("digest"), "compacted")


@query("c5_summary_input", f"WITH {_SPLIT} SELECT session_id, md5(string_agg(upper(role) || ': ' || substring(content, 1, 500), chr(10) ORDER BY pos)) AS digest FROM p WHERE part = 'old' GROUP BY 1", "v_messages")
def c5(spark, d):
    return sessions.summary_input(V.messages(spark, d)).select("session_id", F.md5("prompt").alias("digest"))


@query("c6_prompt_history", "SELECT session_id, md5(string_agg(role || ':' || content, '|' ORDER BY pos)) AS digest FROM v_messages WHERE role IN ('user', 'assistant') GROUP BY 1", "v_messages")
def c6(spark, d):
    m = V.messages(spark, d).where("role in ('user', 'assistant')").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(":", "role", "content").alias("t")))).alias("l"))
    return m.select("session_id", F.md5(F.array_join(F.transform("l", lambda x: x["t"]), "|")).alias("digest"))


@query("c7_grade_log_rows", "SELECT session_id, count(*) AS queries, CAST(sum(latency_ms) AS BIGINT) AS latency_ms, count(DISTINCT k) AS chunks FROM v_grades GROUP BY 1", "v_grades")
def c7(spark, d):
    return V.grades(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("queries"), F.sum("latency_ms").alias("latency_ms"), F.count_distinct("k").alias("chunks"))


@query("m1_run_checkpoint", "SELECT user_id AS run_id, max(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 4 ELSE 7 END) AS last_step, bool_or(event_type = 'purchase') AS done FROM events GROUP BY 1")
def m1(spark, d):
    step = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "error", 4).otherwise(7)
    return V.read(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.max(step).alias("last_step"), F.bool_or(F.col("event_type") == "purchase").alias("done"))


@query("m2_resume_clusters", "SELECT DISTINCT label AS cluster_id FROM embeddings WHERE label NOT IN (0, 1, 2)")
def m2(spark, d):
    c = V.read(spark, d, "embeddings").select(F.col("label").alias("cluster_id")).distinct()
    return c.join(c.where("cluster_id <= 2"), "cluster_id", "left_anti")


@query("m4_mark_processed", "SELECT id, watcher_processed OR rn <= 100 AS watcher_processed FROM (SELECT id, watcher_processed, row_number() OVER (PARTITION BY project_id, watcher_processed ORDER BY created_at DESC, id) AS rn FROM v_grades)", "v_grades")
def m4(spark, d):
    g = V.grades(spark, d)
    done = quality.newest(g.where("not watcher_processed"), "project_id", "created_at", 100).select("id", F.lit(True).alias("now"))
    return g.join(done, "id", "left").select("id", (F.col("watcher_processed") | F.coalesce("now", F.lit(False))).alias("watcher_processed"))


@query("x19_failure_labels", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'missing_concept' WHEN event_type = 'click' THEN 'terminology_gap' WHEN event_type = 'view' THEN 'ok' ELSE 'buried_signal' END AS failure FROM events")
def x19(spark, d):
    label = F.when(F.col("event_type") == "click", " Terminology Gap\n").when(F.col("event_type") == "view", "OK").otherwise("no idea")
    return V.read(spark, d, "events").select("event_id", T.failure_label(label, (F.col("event_id") % 4).cast("int")).alias("failure"))


@query("x20_memory_routing", "SELECT event_id, CASE event_type WHEN 'click' THEN '## Terminology Map' WHEN 'view' THEN '## Cross-Document Connections' ELSE '## Frequently Asked Patterns' END AS section FROM events WHERE event_type IN ('click', 'view', 'purchase') AND length(props) + event_id % 20 >= 20")
def x20(spark, d):
    where = F.create_map(*map(F.lit, ("click", "## Terminology Map", "view", "## Cross-Document Connections", "purchase", "## Frequently Asked Patterns")))
    e = V.read(spark, d, "events").withColumn("section", F.try_element_at(where, F.col("event_type")))
    return e.where("section is not null and length(props) + event_id % 20 >= 20").select("event_id", "section")


@query("x21_epoch_seconds", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS epoch FROM events")
def x21(spark, d):
    iso = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return V.read(spark, d, "events").select("event_id", T.epoch_seconds(iso).alias("epoch"))


@query("x22_json_columns", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 3 <> 0")
def x22(spark, d):
    props = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{broken"), "props")).otherwise(F.col("props"))
    return V.read(spark, d, "events").select("event_id", F.from_json(props, "k long").alias("j")).where("j.k is not null").select("event_id", F.col("j.k").alias("k"))
