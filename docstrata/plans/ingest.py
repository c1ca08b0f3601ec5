"""Sources, table maintenance and chunking over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as t

from docstrata.functions import text as T
from docstrata.operators import chunking
from docstrata.plans.chunk_sql import chunk_sql
from docstrata.plans.registry import query
from docstrata.plans.search import BM25, bm25
from docstrata.sources import committed, hash_store, tables
from docstrata.sources import views as V
from docstrata.sources.shared import shared_folder

_WS = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"


@query("s1_virtual_pages", "SELECT doc_id, page_number, md5(text) AS text_md5, length(text) AS n FROM v_pages", "v_pages")
def s1(spark, d):
    return V.pages(spark, d).select("doc_id", "page_number", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n"))


@query(
    "s2_paragraph_pages",
    r"SELECT doc_id, CAST(i + 1 AS INTEGER) AS page_number, md5(regexp_replace(substring(j, i * 3000 + 1, 3000), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS text_md5 FROM (SELECT doc_id, j, unnest(range(0, CAST(ceil(length(j) / 3000) AS BIGINT))) AS i FROM "
    r"(SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS j FROM conversations WHERE regexp_replace(text, '[\s\p{Z}]+', '', 'g') <> '' GROUP BY conv_id))",
)
def s2(spark, d):
    rows = V.read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text")
    return chunking.paragraph_pages(rows).select("doc_id", "page_number", F.md5("text").alias("text_md5"))


@query(
    "s3_rendered_tables",
    "WITH c AS (SELECT n_regionkey AS t, n_nationkey AS r, unnest([{'k': 0, 'v': n_name}, {'k': 1, 'v': CAST(n_nationkey AS VARCHAR)}, {'k': 2, 'v': CAST(NULL AS VARCHAR)}]) AS x FROM nation), "
    "l AS (SELECT t, r, string_agg(trim(coalesce(x.v, '')), ' | ' ORDER BY x.k) AS line FROM c GROUP BY t, r) SELECT 'nations' AS doc_id, t AS table_no, string_agg(line, chr(10) ORDER BY r) AS text FROM l GROUP BY t",
)
def s3(spark, d):
    n = V.read(spark, d, "nation")
    cells = n.select(F.lit("nations").alias("doc_id"), F.col("n_regionkey").alias("table_no"), F.col("n_nationkey").alias("row_no"), F.posexplode(F.array("n_name", F.col("n_nationkey").cast("string"), F.lit(None).cast("string"))).alias("col_no", "text"))
    return chunking.rendered_tables(cells)


_NAMES = "SELECT page_id, 'page' || page_id || CASE page_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.TXT' WHEN 2 THEN '.docx' WHEN 3 THEN '.exe' WHEN 4 THEN '' ELSE '.doc' END AS filename, CASE WHEN page_id % 7 = 0 THEN 0 WHEN page_id % 11 = 0 THEN 300000000 ELSE length(html) END AS length FROM pages"


@query(
    "s4_format_routing",
    f"WITH f AS (SELECT *, lower(regexp_extract(filename, '(\\.[^./]+)$', 1)) AS extension FROM ({_NAMES})) SELECT page_id, extension, CASE WHEN extension = '.pdf' THEN 'application/pdf' WHEN extension IN ('.docx', '.doc') "
    "THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'text/plain' END AS mime, CASE WHEN extension NOT IN ('.pdf', '.docx', '.doc', '.txt') THEN 'type' WHEN length <= 0 THEN 'empty' WHEN length > 209715200 THEN 'size' END AS reject_reason FROM f",
)
def s4(spark, d):
    tail = F.element_at(F.array(*map(F.lit, (".pdf", ".TXT", ".docx", ".exe", "", ".doc"))), (F.col("page_id") % 6 + 1).cast("int"))
    size = F.when(F.col("page_id") % 7 == 0, 0).when(F.col("page_id") % 11 == 0, 300_000_000).otherwise(F.length("html"))
    files = V.read(spark, d, "pages").select("page_id", F.concat(F.lit("page"), "page_id", tail).alias("filename"), size.alias("length"))
    return tables.route_files(files).select("page_id", "extension", "mime", "reject_reason")


@query("s5_content_hash", "SELECT doc_id, sha256(text) AS file_hash FROM documents")
def s5(spark, d):
    return tables.content_hash(V.read(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "file_hash")


@query("s6_hash_dedup", "SELECT doc_id, nullif(min(doc_id) OVER (PARTITION BY text), doc_id) AS duplicate_of FROM documents")
def s6(spark, d):
    return tables.deduplicate(tables.content_hash(V.read(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "file_hash")).select("doc_id", "duplicate_of")


@query("s6_unseen_batch", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 <> 0)")
def s6b(spark, d):
    docs = tables.content_hash(V.read(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "file_hash")
    return tables.unseen(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")).select("doc_id")


@query("s6_hash_store", "SELECT CASE WHEN first % 10 < 4 THEN 0 WHEN first % 10 < 8 THEN 1 ELSE 2 END AS batch, count(*) AS n FROM (SELECT min(struct_pack(b := CASE WHEN doc_id % 10 < 4 THEN 0 WHEN doc_id % 10 < 8 THEN 1 ELSE 2 END, i := doc_id)).i AS first FROM documents GROUP BY coalesce(text, '')) GROUP BY 1")
def s6_store(spark, d):
    """Documents in three batches against a kept history of content hashes, compacted after the first: new contents of each batch."""
    docs = tables.content_hash(V.read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text").select("doc_id", "file_hash")
    number = F.when(F.col("doc_id") % 10 < 4, 0).when(F.col("doc_id") % 10 < 8, 1).otherwise(2)
    folder, out = f"{shared_folder(spark)}/hashes-{uuid.uuid4().hex}", None
    for batch in range(3):
        new = hash_store.add(spark, folder, docs.where(number == batch), batch).agg(F.count(F.lit(1)).alias("n")).select(F.lit(batch).alias("batch"), "n")
        out = new if out is None else out.unionByName(new)
        if batch == 0:
            hash_store.compact(spark, folder, bucket_rows=1_000)
    return out


@query("s8_session_append_totals", "SELECT session_id, count(*) AS message_count, CAST(sum(token_count) AS BIGINT) AS total_tokens, max(pos) AS last_pos FROM (SELECT session_id, pos, token_count FROM v_messages UNION ALL SELECT session_id, pos + 1000, token_count FROM v_messages WHERE pos = 0) GROUP BY session_id", "v_messages")
def s8(spark, d):
    from docstrata.operators import sessions

    m = V.messages(spark, d)
    return sessions.totals(m.unionByName(m.where("pos = 0").withColumn("pos", F.col("pos") + 1000)))


@query("s9_session_overwrite", "SELECT session_id, count(*) AS n, min(pos) AS first_pos FROM (SELECT session_id, pos FROM v_messages WHERE session_id % 5 <> 0 UNION ALL SELECT session_id, pos FROM v_messages WHERE session_id % 5 = 0 AND pos >= 2) GROUP BY session_id", "v_messages")
def s9(spark, d):
    m = V.messages(spark, d)
    new = m.where("session_id % 5 = 0")
    small = new.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where("n <= 500")
    kept = tables.delete(m, small, "session_id")
    return kept.unionByName(new.where("pos >= 2").join(small.select("session_id"), "session_id", "left_semi").select(*m.columns)).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


@query("s10_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, c_acctbal FROM customer WHERE c_custkey % 10 = 0")
def s10(spark, d):
    c = V.read(spark, d, "customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 4 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(c.where("c_custkey % 10 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000))
    return tables.upsert(c, new, "c_custkey")


@query("s10_committed_table", "SELECT doc_id AS id, source, CASE WHEN doc_id % 3 = 0 THEN n_chars + 1 ELSE n_chars END AS size FROM documents WHERE (doc_id % 2 = 0 OR doc_id % 3 = 0) AND doc_id % 7 <> 0")
def s10c(spark, d):
    """Every second document is committed, every third upserted, every seventh deleted; three versions of one table."""
    docs = V.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.col("n_chars").alias("size"))
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    committed.create(folder, docs.where("id % 2 = 0"), "id", file_rows=20_000)
    committed.upsert(spark, folder, docs.where("id % 3 = 0").withColumn("size", F.col("size") + 1), file_rows=20_000)
    committed.delete(spark, folder, docs.where("id % 7 = 0").select("id"), file_rows=20_000)
    return committed.read(spark, folder)


@query("s11_partial_update", "SELECT id, filename, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'error' ELSE status END AS status, size_bytes FROM v_documents", "v_documents")
def s11(spark, d):
    docs = V.documents(spark, d).select("id", "filename", "status", "size_bytes")
    new = docs.where("cast(id as bigint) % 2 = 0").select("id", F.lit("error").alias("status"), F.lit(None).cast("long").alias("size_bytes"))
    return tables.update_fields(docs, new, "id", "status", "size_bytes")


@query(
    "s12_insert_or_ignore",
    "WITH n AS (SELECT s_suppkey FROM supplier UNION SELECT s_suppkey + 10000 FROM supplier WHERE s_suppkey % 2 = 0) "
    "SELECT s_suppkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, 0.0 FROM n WHERE NOT EXISTS (SELECT 1 FROM supplier o WHERE o.s_suppkey = n.s_suppkey)",
)
def s12(spark, d):
    """Each supplier again, and each even one under a key 10,000 higher: those whose key is there already are ignored."""
    s = V.read(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    new = s.withColumn("s_acctbal", F.lit(0.0)).unionByName(s.where("s_suppkey % 2 = 0").select((F.col("s_suppkey") + 10_000).alias("s_suppkey"), F.lit(0.0).alias("s_acctbal")))
    return tables.insert_or_ignore(s, new, "s_suppkey")


@query("s13_delete_documents", "SELECT chunk_id FROM v_chunks WHERE CAST(doc_id AS BIGINT) % 7 <> 0", "v_chunks")
def s13(spark, d):
    gone = V.documents(spark, d).where("cast(id as bigint) % 7 = 0").select(F.col("id").alias("doc_id"))
    return tables.delete(V.chunks(spark, d), gone, "doc_id").select("chunk_id")


@query("s14_delete_project", "SELECT id, CASE WHEN project_id IN ('src0', 'src3') THEN NULL ELSE project_id END AS project_id FROM v_documents", "v_documents")
def s14(spark, d):
    docs = V.documents(spark, d).select("id", "project_id")
    return tables.detach(docs, docs.where("project_id in ('src0', 'src3')"), "project_id")


@query("s14_cascade_grades", "SELECT id, project_id FROM v_grades WHERE project_id NOT IN (1, 2)", "v_grades")
def s14b(spark, d):
    g = V.grades(spark, d).select("id", "project_id")
    return tables.delete(g, g.where("project_id in (1, 2)"), "project_id").select("id", "project_id")


@query("s15_reassign_blank", "SELECT id, coalesce(nullif(CASE WHEN project_id = 'src1' THEN '' WHEN project_id = 'src2' THEN NULL ELSE project_id END, ''), 'target') AS project_id FROM v_documents", "v_documents")
def s15(spark, d):
    docs = V.documents(spark, d).select("id", F.when(F.col("project_id") == "src1", "").when(F.col("project_id") != "src2", F.col("project_id")).alias("project_id"))
    return tables.reassign_blank(docs, "target")


@query("s16_assign_documents", "SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'src4' ELSE project_id END AS project_id FROM v_documents", "v_documents")
def s16(spark, d):
    docs = V.documents(spark, d).select("id", "project_id")
    ids = docs.select("id", F.col("id").cast("long").alias("n"))
    links = ids.where("n % 3 = 0").select("id", F.lit("src4").alias("project_id")).unionByName(ids.where("n % 3 = 1").select("id", F.lit("nowhere").alias("project_id"))).unionByName(ids.where("n = 1").select(F.lit("missing").alias("id"), F.lit("src4").alias("project_id")))
    return tables.assign(docs, links, docs.select("project_id").distinct()).select("id", "project_id")


@query("s17_schema_growth", "SELECT id, 'unknown' AS language, CAST(0 AS INTEGER) AS page_count, CAST(size_bytes AS BIGINT) AS size_bytes FROM v_documents", "v_documents")
def s17(spark, d):
    schema = t.StructType([t.StructField("id", t.StringType()), t.StructField("language", t.StringType()), t.StructField("page_count", t.IntegerType()), t.StructField("size_bytes", t.LongType())])
    return tables.grown(V.documents(spark, d).select("id", "size_bytes"), schema, {"language": F.lit("unknown"), "page_count": F.lit(0)})


@query(
    "s18_version_snapshots",
    "WITH s AS (SELECT user_id AS document_id, event_id AS saved_at, CASE WHEN event_type = 'purchase' THEN props END AS label FROM events) SELECT document_id, saved_at, label, 3 + row_number() OVER (PARTITION BY document_id ORDER BY saved_at) AS version_no FROM s WHERE label IS NOT NULL",
)
def s18(spark, d):
    e = V.read(spark, d, "events")
    saves = e.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("saved_at"), F.when(F.col("event_type") == "purchase", F.col("props")).alias("label"))
    counts = e.select(F.col("user_id").alias("document_id")).distinct().withColumn("version_count", F.lit(3).cast("long"))
    return tables.snapshot_versions(saves, counts)


_NOTES = "SELECT user_id % 10 AS project_id, CASE event_id % 3 WHEN 0 THEN 'Terminology Map' WHEN 1 THEN 'Cross-Document Connections' ELSE 'Frequently Asked Patterns' END AS section, event_id AS note_no, event_type AS content FROM events WHERE event_type = 'error'"


def _notes(spark, d):
    e = V.read(spark, d, "events").where("event_type = 'error'")
    section = F.when(F.col("event_id") % 3 == 0, "Terminology Map").when(F.col("event_id") % 3 == 1, "Cross-Document Connections").otherwise("Frequently Asked Patterns")
    return e.select((F.col("user_id") % 10).alias("project_id"), section.alias("section"), F.col("event_id").alias("note_no"), F.col("event_type").alias("content"))


@query(
    "s19_memory_notes",
    f"WITH n AS ({_NOTES}), d AS (SELECT * FROM (VALUES (0, 'Terminology Map'), (1, 'Cross-Document Connections'), (2, 'Frequently Asked Patterns'), (3, 'Knowledge Gaps')) v(section_no, section)), "
    "b AS (SELECT project_id, section, string_agg('- ' || content, chr(10) ORDER BY note_no) AS body, count(*) AS c FROM n GROUP BY 1, 2), p AS (SELECT DISTINCT user_id % 10 AS project_id FROM events) "
    "SELECT p.project_id, CAST(sum(coalesce(c, 0)) AS BIGINT) AS entries, string_agg('## ' || d.section || chr(10) || coalesce(body, '_(no entries yet)_'), chr(10) || chr(10) ORDER BY section_no) AS text FROM p CROSS JOIN d LEFT JOIN b ON b.project_id = p.project_id AND b.section = d.section GROUP BY 1",
)
def s19(spark, d):
    return tables.memory_notes(_notes(spark, d), V.read(spark, d, "events").select((F.col("user_id") % 10).alias("project_id")))


@query("s20_memory_rows", f"WITH n AS ({_NOTES}) SELECT 'mem_' || project_id || '__mem__' || (row_number() OVER (PARTITION BY project_id ORDER BY note_no) - 1) AS chunk_id, content AS text, 1 AS page_number, true AS is_memory FROM n")
def s20(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("project_id").orderBy("note_no")) - 1
    return _notes(spark, d).select(F.concat(F.lit("mem_"), "project_id", F.lit("__mem__"), n).alias("chunk_id"), F.col("content").alias("text"), F.lit(1).alias("page_number"), F.lit(True).alias("is_memory"))


@query("k1_token_estimate", "SELECT chunk_id, token_count FROM v_chunks", "v_chunks")
def k1(spark, d):
    return V.chunks(spark, d).select("chunk_id", "token_count")


@query(
    "k2_sentences",
    rf"SELECT doc_id, page_number, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, page_number, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') AS s FROM v_pages)",
    "v_pages",
)
def k2(spark, d):
    s = V.pages(spark, d).withColumn("s", T.sentences(F.col("text")))
    return s.select("doc_id", "page_number", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("k3_adaptive_chunk_size", "SELECT DISTINCT source, lang, CASE lang WHEN 'en' THEN 512 WHEN 'fr' THEN 768 ELSE 640 END AS size FROM documents")
def k3(spark, d):
    mime = F.when(F.col("lang") == "en", "text/plain").when(F.col("lang") == "fr", "application/pdf").otherwise("application/zip")
    return V.read(spark, d, "documents").select("source", "lang", chunking.chunk_size(mime, F.lit(640)).alias("size")).distinct()


@query("k4_sentence_chunks", chunk_sql("SELECT id, text FROM v_documents", 128, 12), "v_documents")
def k4(spark, d):
    return chunking.chunk_pages(V.pages(spark, d), size=128)


@query(
    "k7_table_chunks",
    "SELECT 'd' || n_regionkey || '__p1__table' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) AS chunk_id, n_name AS text, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS chunk_index, true AS is_table FROM nation",
)
def k7(spark, d):
    n = V.read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("v"))
    pages = n.select(F.concat(F.lit("d"), "n_regionkey").alias("doc_id"), F.lit(1).alias("page_number"), F.lit("").alias("text"), F.transform("v", lambda x: x["n_name"]).alias("tables"))
    return chunking.chunk_pages(pages).select("chunk_id", "text", "chunk_index", "is_table")


_PARENT = (
    "p AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY page_number) - 1) // 4 AS g, count(*) OVER (PARTITION BY doc_id) AS n FROM v_chunks), "
    "c AS (SELECT *, CASE WHEN n > 3 THEN doc_id || '__p1__parent' || g END AS parent_id FROM p)"
)


def _parents(spark, d):
    """Pages of a document as the chunks of one page, so that longer documents have parents."""
    chunks = V.chunks(spark, d).withColumn("page_number", F.lit(1)).withColumn("is_table", F.lit(False))
    return chunking.parent_groups(chunks)


@query("k9_parent_groups", f"WITH {_PARENT} SELECT parent_id, md5(string_agg(text, ' ' ORDER BY chunk_index)) AS digest FROM c WHERE parent_id IS NOT NULL GROUP BY parent_id", "v_chunks")
def k9(spark, d):
    return _parents(spark, d)[1].select("parent_id", F.md5("parent_text").alias("digest"))


@query(
    "k10_parent_expansion",
    f"WITH {BM25}, {_PARENT}, j AS (SELECT query_id, rank, coalesce(parent_id, bm.chunk_id) AS chunk_id, row_number() OVER (PARTITION BY query_id, coalesce(parent_id, bm.chunk_id) ORDER BY rank) AS k FROM bm JOIN c ON c.chunk_id = bm.chunk_id WHERE rank <= 40) SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id FROM j WHERE k = 1",
    "v_chunks", "v_queries",
)
def k10(spark, d):
    """The lexical hits of each query, children in favour of their parents."""
    named, parents = _parents(spark, d)
    return chunking.expand_to_parents(bm25(spark, d, 40), named, parents).select("query_id", "rank", "chunk_id")


@query("a9_chunk_counts", "SELECT doc_id, count(*) AS chunk_count, count(DISTINCT page_number) AS page_count FROM v_chunks GROUP BY doc_id", "v_chunks")
def a9(spark, d):
    return V.chunks(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.count_distinct("page_number").alias("page_count"))
