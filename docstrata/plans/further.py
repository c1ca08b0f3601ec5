"""The rest of the inventory: joins, limits, set operations and bookkeeping, each over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from docstrata.functions import text as T
from docstrata.operators import chunking, drafts, graph, plugins, quality, ranking, sessions
from docstrata.plans.chunk_sql import chunk_sql
from docstrata.plans.registry import query
from docstrata.plans.search import _MATCH, _REL, _SEEDS, BM25, VEC, _names, bm25, nearest
from docstrata.plans.writing import _SECTIONS, _markdown
from docstrata.sources import tables
from docstrata.sources import views as V
from docstrata.sources.shared import shared_folder, stored


def _messages_as_lines(spark, d):
    """All sessions as JSON lines in files of many sessions, blank and malformed lines among them, read back."""
    path = f"{shared_folder(spark)}/messages-{uuid.uuid4().hex}"
    rows = V.messages(spark, d).select("session_id", F.to_json(F.struct("session_id", "role", "content")).alias("line"))
    lines = F.array(F.lit(""), F.lit("  "), F.lit('{"session_id": 1, "role": broken'), F.col("line"))
    rows.select(F.explode(lines).alias("line")).write.text(path)
    return tables.read_messages(spark, path, t.StructType().add("session_id", "long").add("role", "string").add("content", "string"))


@query("s7_jsonl_messages", "SELECT session_id, role, count(*) AS n FROM v_messages GROUP BY 1, 2", "v_messages")
def s7(spark, d):
    return _messages_as_lines(spark, d).groupBy("session_id", "role").agg(F.count("content").alias("n"))


@query("s7_jsonl_messages_all", "SELECT session_id, role, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM v_messages GROUP BY 1, 2", "v_messages")
def s7_all(spark, d):
    """The contents of all messages come back whole."""
    return _messages_as_lines(spark, d).groupBy("session_id", "role").agg(F.count("content").alias("n"), F.sum(F.length("content")).alias("chars"))


@query("j3_projects_with_counts", "SELECT n.n_nationkey AS project_id, count(d.doc_id) AS doc_count FROM nation n LEFT JOIN documents d ON d.source = 'src' || n.n_nationkey GROUP BY 1")
def j3(spark, d):
    n = V.read(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), F.concat(F.lit("src"), "n_nationkey").alias("source"))
    counts = V.read(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("doc_count"))
    return n.join(counts, "source", "left").select("project_id", F.coalesce("doc_count", F.lit(0)).alias("doc_count"))


@query("j5_semi_join_ids", "SELECT chunk_id, page_number FROM v_chunks WHERE CAST(doc_id AS BIGINT) IN (SELECT vec_id FROM embeddings WHERE label = 3)", "v_chunks")
def j5(spark, d):
    ids = V.read(spark, d, "embeddings").where("label = 3").select(F.col("vec_id").cast("string").alias("doc_id"))
    return V.chunks(spark, d).join(ids, "doc_id", "left_semi").select("chunk_id", "page_number")


@query("j6_alias_join", f"WITH s AS ({_SEEDS}) SELECT query_id, count(DISTINCT entity_name) AS n FROM s JOIN v_entities e ON e.project_id = s.project_id AND (lower(e.entity_name) = lower(s.name) OR lower(e.synonyms[1]) = lower(s.name)) GROUP BY 1", "v_entities")
def j6(spark, d):
    names = _names(spark, d).withColumn("alias", F.lower("name"))
    return names.join(graph.aliases(V.entities(spark, d)), ["project_id", "alias"]).groupBy("query_id").agg(F.count_distinct("entity_name").alias("n"))


@query("j7_cache_lookup", "SELECT vec_id, label % 2 = 0 AS hit FROM embeddings")
def j7(spark, d):
    v = V.read(spark, d, "embeddings").select("vec_id", "label", T.cache_key(F.lit("p"), F.col("label").cast("string"), F.col("vec_id").cast("string")).alias("cache_key"))
    cache = v.where("label % 2 = 0").select("cache_key", F.lit(True).alias("hit"))
    return v.join(cache, "cache_key", "left").select("vec_id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("j10_edge_expansion", f"WITH {_REL} SELECT project_id, src, count(*) AS degree FROM (SELECT project_id, entity_a AS src FROM rel UNION ALL SELECT project_id, entity_b FROM rel) GROUP BY 1, 2", "v_mentions")
def j10(spark, d):
    rel = graph.build_relations(V.mentions(spark, d))
    both = rel.select("project_id", F.explode(F.array("entity_a", "entity_b")).alias("src"))
    return both.groupBy("project_id", "src").agg(F.count(F.lit(1)).alias("degree"))


@query("j10_edge_expansion_all", f"WITH {_REL}, e AS (SELECT project_id, entity_a AS src FROM rel UNION ALL SELECT project_id, entity_b FROM rel) SELECT project_id, count(*) AS edges, count(DISTINCT src) AS entities FROM e GROUP BY 1", "v_mentions")
def j10_all(spark, d):
    return j10(spark, d).groupBy("project_id").agg(F.sum("degree").alias("edges"), F.count(F.lit(1)).alias("entities"))


@query("j11_settings_fallback", "SELECT id, coalesce(n_name, 'default') AS model FROM v_documents LEFT JOIN nation ON project_id = 'src' || n_nationkey AND n_regionkey <> 1", "v_documents")
def j11(spark, d):
    """The nations of four regions are the projects that have a setting."""
    settings = V.read(spark, d, "nation").where("n_regionkey <> 1").select(F.concat(F.lit("src"), "n_nationkey").alias("project_id"), F.col("n_name").alias("model"))
    docs = V.documents(spark, d).select("id", "project_id")
    return docs.join(F.broadcast(settings), "project_id", "left").select("id", F.coalesce("model", F.lit("default")).alias("model"))  # one row a nation


@query("j14_signature_lookup", f"WITH {_SECTIONS}, t AS (SELECT * FROM (VALUES ('overview', 'executive_summary'), ('scope_of_work', 'scope_statement'), ('deliverables', 'deliverable'), ('timeline', 'timeline'), ('acceptance_criteria', 'acceptance_criterion'), ('payment_terms', 'financial'), ('assumptions', 'assumption_risk')) v(section_id, section_type)) SELECT doc_id, section_id, section_type FROM sc LEFT JOIN t USING (section_id)")
def j14(spark, d):
    """The signature of each section by document and section; sections outside the template have none."""
    texts = stored(_markdown(spark, d))
    found = drafts.signatures(texts).select("doc_id", "section_id", "section_type")
    return drafts.sections(texts).select("doc_id", "section_id").join(found, ["doc_id", "section_id"], "left")


@query("a13_context_usage", "SELECT session_id, CAST(sum(token_count + 4) AS BIGINT) AS used FROM v_messages GROUP BY 1", "v_messages")
def a13(spark, d):
    return sessions.context_status(V.messages(spark, d), F.lit(32768)).select("session_id", F.col("used_tokens").alias("used"))


@query("p7_existence_guard", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def p7(spark, d):
    known = V.read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    return tables.delete(V.read(spark, d, "events").select("event_id", "user_id"), known, "user_id").select("event_id", "user_id")


@query("p10_rolling_window", "SELECT project_id, count(*) AS n FROM v_grades WHERE created_at >= TIMESTAMP '2024-01-24' AND session_id <> 7 GROUP BY 1", "v_grades")
def p10(spark, d):
    g = V.grades(spark, d).where(f"created_at >= timestamp_ntz'{V.AS_OF}' - interval 7 days and session_id <> 7")
    return g.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@query("p14_entity_length", r"WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: length(x) > 3)[1:5] AS w FROM benchmark) SELECT item_id AS query_id, array_to_string(w, ' ') AS names FROM w")
def p14(spark, d):
    words = F.slice(F.filter(F.split(F.lower("query"), r"\s+"), lambda x: F.length(x) > 3), 1, 5)
    return V.text_queries(spark, d).select("query_id", F.array_join(words, " ").alias("names"))


@query("t3_final_top5", f"WITH {VEC} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id FROM vec WHERE rank <= 5", "v_vectors")
def t3(spark, d):
    return ranking.cut(nearest(spark, d), 5).select("query_id", "rank", "chunk_id")


@query("t4_top_entities", "SELECT project_id, entity_name, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY occurrence_count DESC, entity_name) AS k FROM v_entities) WHERE k <= 20", "v_entities")
def t4(spark, d):
    w = Window.partitionBy("project_id").orderBy(F.desc("occurrence_count"), "entity_name")
    return V.entities(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("project_id", "entity_name", "rank")


@query("t8_newest_listing", "SELECT id, size_bytes FROM v_documents ORDER BY size_bytes DESC, id LIMIT 100", "v_documents")
def t8(spark, d):
    return V.documents(spark, d).select("id", "size_bytes").orderBy(F.desc("size_bytes"), "id").limit(100)


@query("t9_version_list", "SELECT document_id, version_no FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version_no DESC) AS k FROM v_versions) WHERE k <= 20", "v_versions")
def t9(spark, d):
    return quality.newest(V.versions(spark, d), "document_id", "version_no", 20, "doc_id").select("document_id", "version_no")


@query("t10_section_chunks", r"WITH k AS (SELECT n_nationkey AS section, list_distinct(list_filter(regexp_split_to_array(lower(n_name || ' the of and'), '[^\p{L}\p{N}_]+'), lambda x: length(x) > 2)) AS k FROM nation), b AS (SELECT item_id, list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS t FROM benchmark), s AS (SELECT section, item_id, row_number() OVER (PARTITION BY section ORDER BY len(list_intersect(k, t)) DESC, item_id) AS r FROM k CROSS JOIN b) SELECT section, item_id, CAST(r AS INTEGER) AS rank FROM s WHERE r <= 5")
def t10(spark, d):
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"))
    k = V.read(spark, d, "nation").select(F.col("n_nationkey").alias("section"), F.filter(words(F.concat("n_name", F.lit(" the of and"))), lambda w: F.length(w) > 2).alias("k"))
    b = V.read(spark, d, "benchmark").select("item_id", words(F.col("text")).alias("t"))
    w = Window.partitionBy("section").orderBy(F.desc("n"), "item_id")
    scored = b.crossJoin(F.broadcast(k)).select("section", "item_id", F.size(F.array_intersect("k", "t")).alias("n"))  # 25 sections
    return scored.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("section", "item_id", "rank")


@query("t11_first_chunks", "SELECT chunk_id FROM (SELECT chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS k FROM v_chunks) WHERE k <= 3", "v_chunks")
def t11(spark, d):
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    return V.chunks(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 3").select("chunk_id")


@query("u2_concatenated_lists", f"WITH {VEC}, {BM25} SELECT query_id, source, CAST(rank AS INTEGER) AS rank, chunk_id FROM (SELECT query_id, 'v' AS source, rank, chunk_id FROM vec WHERE rank <= 10 UNION ALL SELECT query_id, 't', rank + 10, chunk_id FROM bm WHERE rank <= 10)", "v_vectors", "v_chunks", "v_queries")
def u2(spark, d):
    v = nearest(spark, d, 10).select("query_id", F.lit("v").alias("source"), "rank", "chunk_id")
    t = bm25(spark, d, 10).select("query_id", F.lit("t").alias("source"), (F.col("rank") + 10).alias("rank"), "chunk_id")
    return v.unionByName(t)


@query("u3_distinct_chunk_lists", "SELECT count(*) AS n FROM (SELECT DISTINCT project_id, source_chunk_ids FROM v_entities)", "v_entities")
def u3(spark, d):
    return V.entities(spark, d).select("project_id", "source_chunk_ids").distinct().agg(F.count(F.lit(1)).alias("n"))


@query("u5_union_of_ids", f"WITH {VEC}, {BM25} SELECT query_id, count(DISTINCT chunk_id) AS n FROM (SELECT query_id, chunk_id FROM vec WHERE rank <= 50 UNION ALL SELECT query_id, chunk_id FROM bm WHERE rank <= 50) GROUP BY 1", "v_vectors", "v_chunks", "v_queries")
def u5(spark, d):
    both = nearest(spark, d).join(bm25(spark, d), ["query_id", "chunk_id"], "full")
    return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query("w4_running_offset", "SELECT doc_id, page_number, CAST(coalesce(sum(token_count) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM v_chunks", "v_chunks")
def w4(spark, d):
    w = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    return V.chunks(spark, d).select("doc_id", "page_number", F.coalesce(F.sum("token_count").over(w), F.lit(0)).alias("before"))


@query("w6_first_occurrence", "SELECT query_id, chunk_id, source FROM (SELECT project_id AS query_id, entity_type AS source, chunk_id, row_number() OVER (PARTITION BY project_id, chunk_id ORDER BY entity_type, entity_name) AS k FROM v_mentions) WHERE k = 1", "v_mentions")
def w6(spark, d):
    m = V.mentions(spark, d).select(F.col("project_id").alias("query_id"), F.col("entity_type").alias("source"), "chunk_id", "entity_name")
    return ranking.first_occurrences(m, "source", "entity_name").select("query_id", "chunk_id", "source")


@query("w11_parent_numbers", "SELECT chunk_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1) // 4 AS parent_no FROM v_chunks", "v_chunks")
def w11(spark, d):
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    return V.chunks(spark, d).select("chunk_id", F.floor((F.row_number().over(w) - 1) / 4).alias("parent_no"))


@query("x6_heading_to_section", f"WITH {_SECTIONS} SELECT doc_id, section_no, section_id FROM si")
def x6(spark, d):
    """The section that each heading of each text stands for."""
    titles = drafts.headings(drafts.lines(_markdown(spark, d))).where("level is not null")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return titles.select("doc_id", F.row_number().over(w).cast("long").alias("section_no"), drafts.section_id(F.col("title")).alias("section_id"))


_SIZES = " ".join(f"WHEN contains(lower(model), '{key}') THEN {size}" for key, size in sessions.CONTEXT_SIZES)
_KEYS = ", ".join(f"'{key}'" for key, _ in sessions.CONTEXT_SIZES)


@query(
    "x18_context_sizes",
    f"WITH k AS (SELECT [{_KEYS}, 'something', 'else'] AS names), m AS (SELECT conv_id, turn, upper(substr(text, 1, 3)) || names[1 + length(text) % len(names)] || role AS model FROM conversations, k) "
    f"SELECT conv_id, turn, CASE {_SIZES} ELSE 32768 END AS total FROM m",
)
def x18(spark, d):
    """A model name for each turn, chosen by the length of its text, with other letters around it."""
    names = F.array(*map(F.lit, (*(key for key, _ in sessions.CONTEXT_SIZES), "something", "else")))
    model = F.concat(F.upper(F.substring("text", 1, 3)), F.element_at(names, (1 + F.length("text") % F.size(names)).cast("int")), "role")
    return V.read(spark, d, "conversations").select("conv_id", "turn", sessions.context_size(model).alias("total"))


@query("c1_message_tokens", "SELECT session_id, pos, token_count + 4 AS tokens FROM v_messages", "v_messages")
def c1(spark, d):
    return V.messages(spark, d).select("session_id", "pos", (F.col("token_count") + 4).alias("tokens"))


@query("f1_embedding_plugin")
def f1(spark, d):
    """Vectors of chunks through the cache: half of the texts are known."""
    c = V.chunks(spark, d).select("chunk_id", "chunk_index", "text")
    known, _ = plugins.embedded_with_cache(c.where("chunk_index % 2 = 0"), "text", spark.createDataFrame([], "cache_key string, embedding array<float>"), "hash", "m1")
    out, _ = plugins.embedded_with_cache(c, "text", known.select("cache_key", "embedding").dropDuplicates(["cache_key"]), "hash", "m1")
    return out.select("chunk_id", "embedding")


@query("f2_pair_scorer", f"WITH {BM25}, c AS (SELECT b.query_id, b.chunk_id, q.query, c.text FROM bm b JOIN v_queries q USING (query_id) JOIN v_chunks c USING (chunk_id) WHERE rank <= 5), w AS (SELECT query_id, chunk_id, list_distinct(list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) AS q, list_distinct(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS t FROM c) SELECT query_id, chunk_id, round(len(list_intersect(q, t)) / greatest(len(q), 1), 6) AS pair_score FROM w", "v_chunks", "v_queries")
def f2(spark, d):
    c = ranking.cut(bm25(spark, d), 5).join(V.text_queries(spark, d), "query_id").join(V.chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    return plugins.pair_scores(c).select("query_id", "chunk_id", F.round("pair_score", 6).alias("pair_score"))


@query("k5_k6_overlap_and_hard_split", chunk_sql("SELECT id, regexp_replace(text, '[.!?]', '', 'g') AS text FROM v_documents", 64, 12, paged=False), "v_documents")
def k5(spark, d):
    """Whole texts as one page each, so that long sentences are split hard."""
    docs = V.documents(spark, d).select(F.col("id").alias("doc_id"), F.lit(1).alias("page_number"), F.regexp_replace("text", "[.!?]", "").alias("text"))
    return chunking.chunk_pages(docs, size=64, overlap=0.2, whole=True)


@query("k8_chunk_ids", "SELECT chunk_id, chunk_index FROM v_chunks", "v_chunks")
def k8(spark, d):
    return V.chunks(spark, d).select("chunk_id", "chunk_index")


@query("g1_alias_table", "SELECT project_id, count(*) AS n FROM (SELECT DISTINCT project_id, entity_name, unnest([lower(entity_name), lower(synonyms[1])]) AS alias FROM v_entities) GROUP BY 1", "v_entities")
def g1a(spark, d):
    return graph.aliases(V.entities(spark, d)).groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@query("t5_graph_limit", f"WITH {_MATCH} SELECT query_id, count(*) AS n FROM mr WHERE rank <= 5 GROUP BY 1", "v_entities")
def t5(spark, d):
    return graph.match_entities(_names(spark, d), V.entities(spark, d), 5).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query("m3_quality_loop")
def m3(spark, d):
    """All triggered projects at once: newest grades, clusters, failures, notes, and the text of each project's memory."""
    grades = V.grades(spark, d)
    due = quality.triggers(grades, V.AS_OF).where("triggered").select("project_id")
    newest = quality.newest(grades.where("not watcher_processed").join(due, "project_id", "left_semi"), "project_id", "created_at", 100)
    rows = plugins.embedded(newest.select("project_id", "id", "query", "retrieved_chunk_ids", "retrieval_grade"), "query")
    clusters = quality.leader_clusters(rows.select("project_id", "id", "embedding")).join(rows.drop("embedding", "project_id"), "id")
    summed = clusters.groupBy("project_id", "leader_id").agg(
        F.count(F.lit(1)).alias("members"), F.min_by("query", "id").alias("query"), F.min_by("retrieval_grade", "id").alias("first_grade"), F.avg("retrieval_grade").alias("mean_grade"),
        F.array_size(F.array_distinct(F.flatten(F.collect_list("retrieved_chunk_ids")))).alias("n_chunks"),
    )
    label = F.when(F.coalesce("mean_grade", F.lit(0.0)) < 0.3, "terminology gap").when(F.col("members") > 1, "cross doc gap").otherwise("buried signal")
    failed = summed.withColumn("failure", T.failure_label(label, F.col("n_chunks")))
    where = F.create_map(*map(F.lit, ("terminology_gap", "Terminology Map", "cross_doc_gap", "Cross-Document Connections", "buried_signal", "Frequently Asked Patterns")))
    notes = failed.select("project_id", F.try_element_at(where, F.col("failure")).alias("section"), F.col("leader_id").alias("note_no"), F.concat(F.lit("asked about "), "query", F.lit(", "), "members", F.lit(" times")).alias("content")).where("section is not null and length(content) >= 20")
    return tables.memory_notes(notes, due)
