"""Filters, joins, lexical and vector search, fusion and the entity graph."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from docstrata.functions import text as T
from docstrata.operators import block_max, cache_replay, chunking, graph, hybrid, lexical, plugins, ranking, vector_index, vectors
from docstrata.plans.registry import query
from docstrata.sources import tables
from docstrata.sources import views as V
from docstrata.sources.shared import shared_folder, stored

STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TOKENS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
WORDS = (
    r"w0 AS (SELECT query_id, query, list_filter(regexp_split_to_array(regexp_replace(lower(query), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS a FROM v_queries), "
    f"words AS (SELECT query_id, query, CASE WHEN len(list_filter(a, lambda x: x NOT IN ({STOP}))) > 0 THEN list_filter(a, lambda x: x NOT IN ({STOP})) ELSE a END AS w FROM w0)"
)
BM25 = (
    f"{WORDS}, tok AS (SELECT chunk_id, {TOKENS.format('text')} AS t FROM v_chunks), "
    "post AS (SELECT term, chunk_id, count(*) AS tf, first(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY 1, 2), "
    "st AS (SELECT count(*) AS n_chunks, avg(len(t)) AS mean_dl FROM tok), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), "
    f"qt AS (SELECT query_id, mode, len(t) AS n_terms, unnest(t) AS term FROM (SELECT query_id, CASE WHEN len(w) <= 3 THEN 'AND' ELSE 'OR' END AS mode, list_distinct(flatten(list_transform(w, lambda x: {TOKENS.format('x')}))) AS t FROM words)), "
    "sc AS (SELECT query_id, mode, n_terms, chunk_id, count(*) AS found, round(sum(greatest(ln((n_chunks - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_dl))), 8) AS score "
    "FROM qt JOIN post USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY 1, 2, 3, 4), "
    "bm AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM sc WHERE mode = 'OR' OR found = n_terms)"
)
NORM = "sqrt(list_sum(list_transform({}, lambda x: x * x)))"
COSINE = "(list_inner_product({a}, {b}) / ({na} * {nb}))"
VEC = (
    "vq AS (SELECT chunk_no // 20 AS query_id, embedding AS q, project_id AS qp FROM v_vectors WHERE chunk_no % 20 = 0), "
    f"vs AS (SELECT query_id, chunk_id, qp, v.project_id, round({COSINE.format(a='q', b='embedding', na=NORM.format('q'), nb=NORM.format('embedding'))}, 8) AS score FROM vq CROSS JOIN v_vectors v), "
    "vec AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM vs)"
)
FUSED = (
    "lists AS (SELECT query_id, 'v' AS source, rank, chunk_id FROM vec WHERE rank <= 50 UNION ALL SELECT query_id, 't', rank, chunk_id FROM bm WHERE rank <= 50), "
    "fs AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 10) AS score FROM lists GROUP BY 1, 2), fused AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM fs)"
)


def bm25(spark, d, k=50):
    return lexical.search_texts(V.chunks(spark, d), V.text_queries(spark, d), k)


def nearest(spark, d, k=50, **how):
    return vectors.exact_top_k(V.vectors(spark, d), V.vector_queries(spark, d), k=k, **how)


def _by_vector(ranked):
    """Queries under the number of the vector that asks."""
    return ranked.withColumn("query_id", F.col("query_id") * 20)


def fused(spark, d):
    lists = nearest(spark, d).withColumn("source", F.lit("v")).unionByName(bm25(spark, d).withColumn("source", F.lit("t")))
    return ranking.fuse(lists)


@query("flagship_hybrid_search", f"WITH {BM25}, {VEC}, {FUSED} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM fused WHERE rank <= 5", "v_chunks", "v_queries", "v_vectors")
def flagship(spark, d):
    return ranking.cut(fused(spark, d), 5).select("query_id", "rank", "chunk_id", "score")


@query("flagship_hybrid_search_all", f"WITH {BM25}, {VEC}, {FUSED} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM fused", "v_chunks", "v_queries", "v_vectors")
def flagship_all(spark, d):
    """The fused list before it is cut."""
    return fused(spark, d).select("query_id", "rank", "chunk_id", "score")


@query("r1_postings", f"WITH t AS (SELECT chunk_id, unnest({TOKENS.format('text')}) AS term FROM v_chunks) SELECT term, count(*) AS tf, count(DISTINCT chunk_id) AS df FROM t GROUP BY term", "v_chunks")
def r1(spark, d):
    return lexical.postings(V.chunks(spark, d)).groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


@query("r1_stemmed_vocabulary")
def r1s(spark, d):
    return lexical.with_stem(lexical.vocabulary(V.chunks(spark, d))).groupBy("stem").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("terms"))


@query("r2_query_rewrite", f"WITH {WORDS} SELECT query_id, CASE WHEN len(w) <= 3 THEN array_to_string(list_transform(w, lambda x: '\"' || x || '\"'), ' AND ') ELSE array_to_string(list_transform(w, lambda x: '\"' || x || '\"'), ' OR ') END AS match FROM words", "v_queries")
def r2(spark, d):
    return V.text_queries(spark, d).select("query_id", T.fts_expression(T.query_words(F.col("query"))).alias("match"))


@query("r3_bm25_top50", f"WITH {BM25} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM bm WHERE rank <= 50", "v_chunks", "v_queries")
def r3(spark, d):
    return bm25(spark, d)


@query("r3_kept_index", f"WITH {BM25.replace('FROM v_chunks', 'FROM v_chunks WHERE CAST(doc_id AS BIGINT) % 7 <> 0')} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM bm WHERE rank <= 50", "v_chunks", "v_queries")
def r3k(spark, d):
    """An index that is built, appended to and deleted from, then searched: documents of every seventh id are gone."""
    folder, chunks = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", V.chunks(spark, d)
    third, seventh = F.col("doc_id").cast("long") % 3 == 0, F.col("doc_id").cast("long") % 7 == 0
    lexical.build(chunks.where(third), folder)
    lexical.delete(folder, chunks.where(third & seventh), 1)
    lexical.append(folder, chunks.where(~third & ~seventh), 2)
    return lexical.search(lexical.read(spark, folder, "string"), V.text_queries(spark, d))


@query("r3_block_max", f"WITH {BM25.replace('FROM v_chunks', 'FROM v_chunks WHERE CAST(doc_id AS BIGINT) % 7 <> 0')} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM bm WHERE rank <= 50", "v_chunks", "v_queries")
def r3b(spark, d):
    """As r3_kept_index, from blocks with bounds: built on a third, deleted from, appended to, and searched."""
    chunks = V.chunks(spark, d)
    third, seventh = F.col("doc_id").cast("long") % 3 == 0, F.col("doc_id").cast("long") % 7 == 0
    folder = block_max.build(chunks.where(third))
    block_max.delete(spark, folder, chunks.where(third & seventh), 1)
    block_max.append(folder, chunks.where(~third & ~seventh), 2)
    return block_max.search(spark, folder, V.text_queries(spark, d))


@query("r4_blank_queries", f"WITH {BM25}, n AS (SELECT query_id, count(*) AS hits FROM bm WHERE rank <= 50 GROUP BY 1) SELECT item_id AS query_id, CASE WHEN length(text) % 2 = 0 THEN 0 ELSE coalesce(hits, 0) END AS hits FROM benchmark LEFT JOIN n ON n.query_id = item_id", "v_chunks", "v_queries")
def r4(spark, d):
    """Queries of even length are blanked: they have no hits, the others keep theirs."""
    q = V.text_queries(spark, d)
    blank = q.withColumn("query", F.when(F.length("query") % 2 == 0, "  ?! ").otherwise(F.col("query")))
    hits = lexical.search_texts(V.chunks(spark, d), blank).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    return q.join(hits, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"))


@query("v1_cosine", f"SELECT a.chunk_no AS a, b.chunk_no AS b, round({COSINE.format(a='a.embedding', b='b.embedding', na=NORM.format('a.embedding'), nb=NORM.format('b.embedding'))}, 6) AS score FROM v_vectors a JOIN v_vectors b ON b.chunk_no = a.chunk_no + 1", "v_vectors")
def v1(spark, d):
    v = V.vectors(spark, d)
    a, b = v.select(F.col("chunk_no").alias("a"), F.col("embedding").alias("ea")), v.select((F.col("chunk_no") - 1).alias("a"), F.col("chunk_no").alias("b"), F.col("embedding").alias("eb"))
    return a.join(b, "a").select("a", "b", F.round(T.cosine(F.col("ea"), F.col("eb")), 6).alias("score"))


@query("v2_exact_top50", f"WITH {VEC} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM vec WHERE rank <= 50", "v_vectors")
def v2(spark, d):
    return nearest(spark, d)


@query("v2_top10_in_project", f"WITH {VEC}, o AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM vs WHERE qp = project_id) SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM o WHERE rank <= 10", "v_vectors")
def v2p(spark, d):
    return nearest(spark, d, 10, same_project=True)


@query("v3_approximate_top20")
def v3(spark, d):
    return vector_index.approximate_top_k(V.vectors(spark, d), V.vector_queries(spark, d))


@query("v3_kept_index_recall", f"WITH {VEC}, d AS (SELECT DISTINCT query_id FROM vs) SELECT count(*) AS queries, TRUE AS recall_reaches_90, TRUE AS same_again, CAST(0 AS BIGINT) AS deleted_found FROM d", "v_vectors")
def v3k(spark, d):
    """An index that is built on a third of the vectors, deleted from, appended to, and searched twice, beside the exact search."""
    v, asked = V.vectors(spark, d), V.vector_queries(spark, d)
    third, seventh = F.col("chunk_no") % 3 == 0, F.col("chunk_no") % 7 == 0
    folder = vector_index.build(v.where(third))
    vector_index.append(folder, v.where(~third), 2)
    vector_index.delete(folder, v.where(seventh), 2)
    first, again = (stored(vector_index.search(folder, asked)) for _ in range(2))
    exact = vectors.exact_top_k(v.where(~seventh), asked, k=20)
    both = exact.join(first.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    differ = first.exceptAll(again).agg(F.count(F.lit(1)).alias("n"))
    gone = first.join(v.where(seventh).select("chunk_id"), "chunk_id").agg(F.count(F.lit(1)).alias("deleted_found"))
    told = first.agg(F.count_distinct("query_id").alias("queries")).crossJoin(both).crossJoin(differ).crossJoin(gone)  # one row each
    return told.select("queries", (F.col("recall") >= 0.9).alias("recall_reaches_90"), (F.col("n") == 0).alias("same_again"), "deleted_found")


@query("v2_exact_top50_all", f"WITH {VEC} SELECT query_id * 20 AS query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM vec WHERE rank <= 50", "v_vectors")
def v2_all(spark, d):
    return _by_vector(nearest(spark, d))


@query("v2_top10_in_project_all", f"WITH {VEC}, o AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM vs WHERE qp = project_id) SELECT query_id * 20 AS query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM o WHERE rank <= 10", "v_vectors")
def v2p_all(spark, d):
    return _by_vector(nearest(spark, d, 10, same_project=True))


@query("v2_top10_of_document", f"WITH {VEC}, o AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM vs WHERE CAST(split_part(chunk_id, '__', 1) AS BIGINT) // 10 = query_id * 2) SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM o WHERE rank <= 10", "v_vectors")
def v2d(spark, d):
    """Search inside one document: the scope is the document number of the vector that asks."""
    v = V.vectors(spark, d).withColumn("project_id", F.col("doc_no"))
    asked = V.vector_queries(spark, d).withColumn("query_project", F.col("query_id") * 2)
    return vectors.exact_top_k(v, asked, k=10, same_project=True)


@query("v3_approximate_top20_all")
def v3_all(spark, d):
    return _by_vector(vector_index.approximate_top_k(V.vectors(spark, d), V.vector_queries(spark, d)))


@query("v4_dimension_check", "SELECT chunk_no FROM v_vectors WHERE len(embedding) <> 64 OR chunk_no % 9 = 0", "v_vectors")
def v4(spark, d):
    v = V.vectors(spark, d).withColumn("embedding", F.when(F.col("chunk_no") % 9 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    return vectors.wrong_dimensions(v, 64).select("chunk_no")


@query("v5_point_id", "SELECT chunk_id, CAST(CAST('0x' || substr(sha256(chunk_id), 1, 16) AS UHUGEINT) % CAST('9223372036854775808' AS UHUGEINT) AS BIGINT) AS point_id FROM v_chunks", "v_chunks")
def v5(spark, d):
    return V.chunks(spark, d).select("chunk_id", T.point_id(F.col("chunk_id")).alias("point_id"))


@query("v6_cache_hits", "SELECT project_id, count(*) AS n, count(*) FILTER (WHERE chunk_index % 2 = 0) AS hits FROM v_chunks GROUP BY 1", "v_chunks")
def v6(spark, d):
    c = V.chunks(spark, d).select("project_id", "chunk_index", F.concat("chunk_id", "text").alias("text")).withColumn("cache_key", T.cache_key(F.lit("hash"), F.lit("m1"), F.col("text")))
    cache = c.where("chunk_index % 2 = 0").select("cache_key").distinct().withColumn("hit", F.lit(True))
    return c.join(cache, "cache_key", "left").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))


@query("v7_cache_key", "SELECT chunk_id, sha256('hash:m1:' || sha256(text)) AS cache_key FROM v_chunks", "v_chunks")
def v7(spark, d):
    return V.chunks(spark, d).select("chunk_id", T.cache_key(F.lit("hash"), F.lit("m1"), F.col("text")).alias("cache_key"))


@query("v8_zero_vectors", f"WITH {VEC}, z AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs WHERE project_id % 2 = 1 AND qp % 3 <> 0) SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM z WHERE rank <= 5", "v_vectors")
def v8(spark, d):
    """Vectors of every second project, and queries of every third, are zero: the first are no hits, the others find none."""
    zero = lambda df, column, when: df.withColumn(column, F.when(when, F.transform(column, lambda x: x * 0)).otherwise(F.col(column)))
    v, asked = zero(V.vectors(spark, d), "embedding", F.col("project_id") % 2 == 0), zero(V.vector_queries(spark, d), "query_embedding", F.col("query_project") % 3 == 0)
    return vectors.exact_top_k(v, asked, k=5)


@query("r5_weighted_merge", f"WITH {BM25}, {VEC}, m AS (SELECT query_id, chunk_id, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END AS s, src FROM (SELECT query_id, chunk_id, score, 'v' AS src FROM vec WHERE rank <= 50 UNION ALL SELECT query_id, chunk_id, score, 't' FROM bm WHERE rank <= 50) WINDOW w AS (PARTITION BY query_id, src)), "
    "a AS (SELECT query_id, chunk_id, round(coalesce(sum(s) FILTER (WHERE src = 'v'), 0) * 0.7 + coalesce(sum(s) FILTER (WHERE src = 't'), 0) * 0.3, 8) AS score FROM m GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM a) SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM r WHERE rank <= 20", "v_chunks", "v_queries", "v_vectors")
def r5(spark, d):
    return ranking.cut(ranking.weighted_merge(nearest(spark, d), bm25(spark, d)), 20).select("query_id", "rank", "chunk_id", "score")


@query("r6_reciprocal_rank_fusion", f"WITH {BM25}, {VEC}, {FUSED} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 8) AS score FROM fused", "v_chunks", "v_queries", "v_vectors")
def r6(spark, d):
    return fused(spark, d).select("query_id", "rank", "chunk_id", F.round("score", 8).alias("score"))


def _three(spark, d):
    entity = bm25(spark, d).where("rank % 3 = 0").withColumn("rank", (F.col("rank") / 3).cast("int"))
    return nearest(spark, d).withColumn("source", F.lit("v")).unionByName(bm25(spark, d).withColumn("source", F.lit("t"))).unionByName(entity.withColumn("source", F.lit("e")))


@query("r7_three_source_fusion", f"WITH {BM25}, {VEC}, l AS (SELECT query_id, rank, chunk_id FROM vec WHERE rank <= 50 UNION ALL SELECT query_id, rank, chunk_id FROM bm WHERE rank <= 50 UNION ALL SELECT query_id, rank // 3, chunk_id FROM bm WHERE rank <= 50 AND rank % 3 = 0), f AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 8) AS score FROM l GROUP BY 1, 2) SELECT query_id, chunk_id, score FROM f", "v_chunks", "v_queries", "v_vectors")
def r7(spark, d):
    return ranking.fuse(_three(spark, d)).select("query_id", "chunk_id", F.round("score", 8).alias("score"))


@query("r8_multi_query_fusion", f"WITH {VEC}, h AS (SELECT query_id // 4 AS q, rank, chunk_id FROM vec WHERE rank <= 30), f AS (SELECT q AS query_id, chunk_id, round(sum(1 / (60 + rank)), 8) AS score FROM h GROUP BY 1, 2) SELECT query_id, chunk_id, score FROM f", "v_vectors")
def r8(spark, d):
    variants = nearest(spark, d, 30).withColumn("query_id", F.floor(F.col("query_id") / 4))
    return ranking.fuse(variants).select("query_id", "chunk_id", F.round("score", 8).alias("score"))


@query("r9_passage_split", "WITH r AS (SELECT item_id, text || ' --- ' || lower(text) || '---  --- tail' AS t FROM benchmark), s AS (SELECT item_id, list_filter(list_transform(string_split(t, '---'), lambda x: trim(x)), lambda x: x <> '')[1:2] AS p FROM r) SELECT item_id AS query_id, unnest(p) AS passage, unnest(range(0, len(p))) AS pos FROM s")
def r9(spark, d):
    t = F.concat("query", F.lit(" --- "), F.lower("query"), F.lit("---  --- tail"))
    parts = F.slice(F.filter(F.transform(F.split(t, "---"), T.strip), lambda x: x != ""), 1, 2)
    return V.text_queries(spark, d).select("query_id", F.posexplode(parts).alias("pos", "passage")).select("query_id", F.col("pos").cast("long").alias("pos"), "passage")


@query("r10_embedding_blend", f"WITH b AS (SELECT a.chunk_no AS query_id, a.embedding AS q, list_transform(list_zip(b.embedding, c.embedding), lambda z: z[1] + z[2]) AS h FROM v_vectors a JOIN v_vectors b ON b.chunk_no = a.chunk_no + 1 JOIN v_vectors c ON c.chunk_no = a.chunk_no + 2), m AS (SELECT query_id, list_transform(list_zip(q, list_transform(h, lambda x: x / {NORM.format('h')})), lambda z: 0.5 * z[1] + 0.5 * z[2]) AS v FROM b) SELECT query_id, round(v[1] / {NORM.format('v')}, 6) AS x1, round(v[64] / {NORM.format('v')}, 6) AS x64 FROM m", "v_vectors")
def r10(spark, d):
    v = V.vectors(spark, d)
    other = lambda i: v.select((F.col("chunk_no") - i).alias("chunk_no"), F.col("embedding").alias(f"h{i}"))
    out = v.join(other(1), "chunk_no").join(other(2), "chunk_no").withColumn("b", vectors.blended(F.col("embedding"), F.array("h1", "h2")))
    return out.select(F.col("chunk_no").alias("query_id"), F.round(F.col("b")[0], 6).alias("x1"), F.round(F.col("b")[63], 6).alias("x64"))


@query("r11_subquery_fusion", f"WITH {VEC}, h AS (SELECT query_id // 5 AS q, chunk_id, (query_id % 5) * 100 + rank AS position FROM vec WHERE rank <= 20), f AS (SELECT q, chunk_id, count(*) AS c, min(position) AS first FROM h GROUP BY 1, 2) SELECT q AS query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY c DESC, first, chunk_id) AS INTEGER) AS rank, chunk_id, round(c / 61, 8) AS score FROM f", "v_vectors")
def r11(spark, d):
    hits = nearest(spark, d, 20).select(F.floor(F.col("query_id") / 5).alias("query_id"), "chunk_id", ((F.col("query_id") % 5) * 100 + F.col("rank")).alias("position"))
    return ranking.fuse_subqueries(hits).select("query_id", "rank", "chunk_id", F.round("score", 8).alias("score"))


_HOP = " OR ".join(f"regexp_matches(q, '(?i){p}')" for p in T.MULTI_HOP)


@query("r12_multi_hop", f"WITH s AS (SELECT conv_id, turn, text || CASE (conv_id + turn) % 5 WHEN 0 THEN ' compare a' WHEN 1 THEN ' a vs. b' WHEN 2 THEN ' both x and' ELSE '' END AS q FROM conversations) SELECT conv_id, turn, {_HOP} AS multi_hop FROM s")
def r12(spark, d):
    n = (F.col("conv_id") + F.col("turn")) % 5
    q = F.concat("text", F.when(n == 0, " compare a").when(n == 1, " a vs. b").when(n == 2, " both x and").otherwise(""))
    return V.read(spark, d, "conversations").select("conv_id", "turn", T.any_match(q, T.MULTI_HOP).alias("multi_hop"))


_PIECES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^[\s\p{Z}\x0B\x1C-\x1F\x85]+|[\s\p{Z}\x0B\x1C-\x1F\x85]+$', '', 'g')), lambda x: x <> '')"


@query("r13_subquery_parsing", f"WITH p AS (SELECT conv_id, turn, text, {_PIECES} AS p FROM conversations) SELECT conv_id, turn, unnest(CASE WHEN len(p) BETWEEN 2 AND 4 THEN p ELSE [text] END) AS sub_query FROM p")
def r13(spark, d):
    """Turns as responses, a sentence a line: two to four lines are sub-queries, else the turn itself is the query."""
    parts = F.filter(F.transform(F.split(F.regexp_replace("text", r"([.!?]) ", "$1\n"), "\n"), T.strip), lambda x: x != "")
    return V.read(spark, d, "conversations").select("conv_id", "turn", F.explode(F.when(F.size(parts).between(2, 4), parts).otherwise(F.array("text"))).alias("sub_query"))


@query("r14_rerank", f"WITH {BM25}, c AS (SELECT * FROM bm WHERE rank <= 50), " + r"w AS (SELECT c.query_id, c.chunk_id, c.rank, list_distinct(list_filter(regexp_split_to_array(lower(q.query), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS q, list_distinct(regexp_split_to_array(lower(t.text), '[^\p{L}\p{N}_]+')) AS t FROM c JOIN v_queries q ON q.query_id = c.query_id JOIN v_chunks t ON t.chunk_id = c.chunk_id), "
    "p AS (SELECT query_id, chunk_id, rank, CASE WHEN rank % 4 <> 0 THEN round(len(list_intersect(q, t)) / greatest(len(q), 1), 6) END AS s FROM w), r AS (SELECT query_id, chunk_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, rank) AS k FROM p) SELECT query_id, CAST(k AS INTEGER) AS rank, chunk_id, s AS score FROM r WHERE k <= 20", "v_chunks", "v_queries")
def r14(spark, d):
    """By pair scores of query and text; each fourth candidate has none."""
    c = stored(bm25(spark, d))
    texts = c.where("rank % 4 <> 0").join(V.text_queries(spark, d), "query_id").join(V.chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    return ranking.rerank(c, plugins.pair_scores(texts).select("query_id", "chunk_id", F.round("pair_score", 6).alias("pair_score")))


# Lists of each query's candidates by rank, then a recursion that appends the next pick; a candidate's value is -9 once picked.
MMR = (
    "ml AS (SELECT c.query_id, list(c.chunk_id ORDER BY c.rank) AS ids, list(c.u ORDER BY c.rank) AS us, list(list_inner_product(c.u, c.qu) ORDER BY c.rank) AS rel, count(*) AS n FROM mc c GROUP BY 1), "
    "mv AS (SELECT query_id, 0 AS step, []::BIGINT[] AS picked FROM ml UNION ALL SELECT query_id, step + 1, list_append(picked, list_position(vals, list_max(vals))) FROM ("
    "SELECT m.query_id, m.step, m.picked, list_transform(range(1, l.n + 1), lambda i: CASE WHEN list_contains(m.picked, i) THEN -9.0 ELSE round(0.7 * l.rel[i] - 0.3 * coalesce(list_max(list_transform(m.picked, lambda j: list_inner_product(l.us[i], l.us[j]))), 0), 10) END) AS vals "
    "FROM mv m JOIN ml l ON l.query_id = m.query_id WHERE m.step < least({k}, l.n))), "
    "mmr AS (SELECT v.query_id, unnest(range(1, len(v.picked) + 1)) AS rank, unnest(list_transform(v.picked, lambda i: l.ids[i])) AS chunk_id FROM mv v JOIN ml l ON l.query_id = v.query_id WHERE v.step = least({k}, l.n))"
)
_UNIT = "list_transform({0}, lambda x: x / " + NORM.format("{0}") + ")"


@query("r15_mmr", f"WITH RECURSIVE {VEC}, mc AS (SELECT v.query_id, v.rank, v.chunk_id, {_UNIT.format('e.embedding')} AS u, {_UNIT.format('q.q')} AS qu FROM vec v JOIN v_vectors e ON e.chunk_id = v.chunk_id JOIN vq q ON q.query_id = v.query_id WHERE v.rank <= 50), {MMR.format(k=20)} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id FROM mmr", "v_vectors")
def r15(spark, d):
    v = V.vectors(spark, d).select("chunk_id", "embedding")
    return ranking.diversify(nearest(spark, d).join(v, "chunk_id").join(V.vector_queries(spark, d).drop("query_project"), "query_id"), 20)


@query("r16_mode_parameters", "SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'balanced' ELSE 'max' END AS mode, CASE WHEN item_id % 3 = 0 THEN 10 ELSE 20 END AS mmr_k, item_id % 3 <> 0 AS rerank, item_id % 3 = 2 AS parents FROM benchmark")
def r16(spark, d):
    modes = spark.createDataFrame([("fast", 10, False, False), ("balanced", 20, True, False), ("max", 20, True, True)], "mode string, mmr_k int, rerank boolean, parents boolean")
    mode = F.element_at(F.array(*map(F.lit, ("fast", "balanced", "max"))), (F.col("query_id") % 3 + 1).cast("int"))
    return V.text_queries(spark, d).select("query_id", mode.alias("mode")).join(F.broadcast(modes), "mode").select("query_id", "mode", "mmr_k", "rerank", "parents")  # three rows


@query("r18_retry_routing", "SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 AND item_id % 2 = 0 THEN 'rewrite' WHEN item_id % 3 = 1 AND item_id % 4 > 1 THEN 'repeat' ELSE 'keep' END AS route FROM benchmark")
def r18(spark, d):
    q = V.text_queries(spark, d)
    label = F.element_at(F.array(*map(F.lit, ("IRRELEVANT", "AMBIGUOUS", "RELEVANT"))), (F.col("query_id") % 3 + 1).cast("int"))
    rewrite = F.when(F.col("query_id") % 2 == 0, F.concat("query", F.lit(" again"))).otherwise(F.col("query"))
    route = F.when((label == "IRRELEVANT") & (rewrite != F.col("query")), "rewrite").when((label == "AMBIGUOUS") & (F.col("query_id") % 4 > 1), "repeat").otherwise("keep")
    return q.select("query_id", route.alias("route"))


@query("r19_source_text", f"WITH {BM25} SELECT b.query_id, md5(string_agg('[' || d.filename || ', p.' || c.page_number || ']' || chr(10) || c.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS digest FROM bm b JOIN v_chunks c USING (chunk_id) JOIN v_documents d ON d.id = c.doc_id WHERE rank <= 5 GROUP BY 1", "v_chunks", "v_queries")
def r19(spark, d):
    rows = ranking.cut(bm25(spark, d), 5).join(V.chunks(spark, d).select("chunk_id", "doc_id", "page_number", "text"), "chunk_id").join(V.documents(spark, d).select(F.col("id").alias("doc_id"), "filename"), "doc_id")
    part = F.concat(F.lit("["), "filename", F.lit(", p."), "page_number", F.lit("]\n"), "text")
    joined = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("p"))
    return joined.select("query_id", F.md5(F.array_join(F.transform("p", lambda x: x["part"]), "\n\n---\n\n")).alias("digest"))


@query("r20_query_cache_exact", "SELECT conv_id, turn, md5(lower(trim(text))) IN (SELECT md5(lower(trim(text))) FROM conversations WHERE turn = 0) AS hit FROM conversations WHERE turn > 0")
def r20(spark, d):
    c = V.read(spark, d, "conversations").withColumn("key", F.md5(F.lower(F.trim("text"))))
    known = c.where("turn = 0").select("key").distinct().withColumn("hit", F.lit(True))
    return c.where("turn > 0").join(known, "key", "left").select("conv_id", "turn", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("r21_query_cache_similar", f"WITH {VEC}, c AS (SELECT query_id, max(score) AS best FROM vs WHERE CAST(split_part(chunk_id, '__', 1) AS BIGINT) % 20 <> 0 AND qp = project_id GROUP BY 1) SELECT query_id, best, best >= 0.92 AS hit FROM c", "v_vectors")
def r21(spark, d):
    cached = V.vectors(spark, d).where("chunk_no % 20 <> 0")
    best = vectors.exact_top_k(cached, V.vector_queries(spark, d), k=1, same_project=True)
    return best.select("query_id", F.col("score").alias("best"), (F.col("score") >= 0.92).alias("hit"))


@query("r21_query_cache_similar_all", f"WITH {VEC}, c AS (SELECT query_id, max(score) AS best FROM vs WHERE CAST(split_part(chunk_id, '__', 1) AS BIGINT) % 20 <> 0 AND qp = project_id GROUP BY 1) SELECT query_id * 20 AS query_id, best, best >= 0.92 AS hit FROM c", "v_vectors")
def r21_all(spark, d):
    return _by_vector(r21(spark, d))


@query(
    "r21_lru_replay",
    "WITH a AS (SELECT row_number() OVER (ORDER BY event_id) AS i, event_id, user_id || '-' || event_type AS key FROM events), "
    "p AS (SELECT *, lag(i) OVER (PARTITION BY key ORDER BY i) AS p FROM a), "
    "d AS (SELECT x.event_id, count(y.i) AS apart FROM p x LEFT JOIN p y ON y.i > x.p AND y.i < x.i AND coalesce(y.p, 0) < x.p WHERE x.p IS NOT NULL GROUP BY 1) "
    "SELECT event_id, coalesce(apart < 200, false) AS hit FROM a LEFT JOIN d USING (event_id)",
)
def r21_lru(spark, d):
    """The log of events through a cache of 200 keys, a key for each user and kind: a hit is a key with fewer than 200 others since its last use."""
    e = V.read(spark, d, "events").select(F.col("event_id").alias("at"), F.concat_ws("-", "user_id", "event_type").alias("key"))
    return cache_replay.replay(e, 200).select(F.col("at").alias("event_id"), "hit")


@query("t6_cache_contents", "SELECT o_custkey || '-' || o_orderpriority AS key, max(o_orderkey) AS last_use FROM orders GROUP BY 1 ORDER BY last_use DESC LIMIT 50000")
def t6_contents(spark, d):
    """What a cache of 50,000 keys holds after all orders, each the use of a key of its customer and priority."""
    o = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("at"), F.concat_ws("-", "o_custkey", "o_orderpriority").alias("key"))
    return cache_replay.contents(o, 50_000).withColumnRenamed("at", "last_use")


@query("r22_cache_invalidation", "SELECT item_id AS query_id FROM benchmark WHERE item_id % 5 <> 2")
def r22(spark, d):
    cache = V.text_queries(spark, d).withColumn("scope", F.col("query_id") % 5)
    return cache.join(cache.where("scope = 2").select("scope").distinct(), "scope", "left_anti").select("query_id")


@query("w7_min_max", f"WITH {VEC} SELECT query_id, chunk_id, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) AS score FROM vec WHERE rank <= 50 WINDOW w AS (PARTITION BY query_id)", "v_vectors")
def w7(spark, d):
    return ranking.min_max(nearest(spark, d).withColumn("source", F.lit("v"))).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("u4_ordered_merge", f"WITH {VEC}, l AS (SELECT query_id // 2 AS q, query_id % 2 AS part, rank, chunk_id FROM vec WHERE rank <= 25), f AS (SELECT *, row_number() OVER (PARTITION BY q, chunk_id ORDER BY part, rank) AS k FROM l) SELECT q AS query_id, part, CAST(rank AS INTEGER) AS rank, chunk_id FROM f WHERE k = 1", "v_vectors")
def u4(spark, d):
    lists = nearest(spark, d, 25).select(F.floor(F.col("query_id") / 2).alias("query_id"), (F.col("query_id") % 2).alias("part"), "rank", "chunk_id")
    return ranking.first_occurrences(lists, "part", "rank")


@query("p6_threshold_keep_one", f"WITH {VEC}, k AS (SELECT *, count(*) FILTER (WHERE round(score, 6) >= 0.6 AND rank > 1) OVER (PARTITION BY query_id) AS g FROM vec WHERE rank BETWEEN 2 AND 20) SELECT query_id, CAST(rank - 1 AS INTEGER) AS rank, chunk_id FROM k WHERE round(score, 6) >= 0.6 OR (rank = 2 AND g = 0)", "v_vectors")
def p6(spark, d):
    hits = nearest(spark, d, 20).where("rank > 1").withColumn("rank", F.col("rank") - 1).withColumn("score", F.round("score", 6))
    return ranking.threshold(hits, 0.6).select("query_id", "rank", "chunk_id")


@query("p1_p2_scope", "SELECT chunk_id FROM v_chunks WHERE project_id = 'src3' AND page_number <= 2", "v_chunks")
def p1(spark, d):
    return V.chunks(spark, d).where("project_id = 'src3' and page_number <= 2").select("chunk_id")


@query("p3_filename_filter", "SELECT item_id AS query_id, (SELECT min(CAST(id AS BIGINT)) FROM v_documents WHERE contains(lower(filename), 'src' || (item_id % 20) || '_')) AS doc_id FROM benchmark", "v_documents")
def p3(spark, d):
    q = V.text_queries(spark, d).select("query_id", F.concat(F.lit("SRC"), F.col("query_id") % 20, F.lit("_")).alias("name"))
    docs = V.documents(spark, d).select(F.col("id").cast("long").alias("doc_id"), "filename")
    hits = tables.named_like(q, docs, "doc_id").groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    return q.select("query_id").join(hits, "query_id", "left")


@query("p4_inline_filters", r"WITH s AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'find File:report.pdf ' || text WHEN 1 THEN text || '  source:PDF now' ELSE text END AS q FROM benchmark) SELECT item_id AS query_id, nullif(regexp_extract(q, '(?i)\bfile:([^\s]+)', 1), '') AS filename, nullif(lower(regexp_extract(q, '(?i)\bsource:(pdf|csv|docx|txt)\b', 1)), '') AS source_type, trim(regexp_replace(regexp_replace(regexp_replace(q, '(?i)\bfile:[^\s]+', '', 'g'), '(?i)\bsource:(pdf|csv|docx|txt)\b', '', 'g'), '\s+', ' ', 'g')) AS bare FROM s")
def p4(spark, d):
    m = F.col("query_id") % 3
    q = F.when(m == 0, F.concat(F.lit("find File:report.pdf "), "query")).when(m == 1, F.concat("query", F.lit("  source:PDF now"))).otherwise(F.col("query"))
    return V.text_queries(spark, d).select("query_id", T.filename_filter(q).alias("filename"), T.source_filter(q).alias("source_type"), T.without_filters(q).alias("bare"))


@query("p12_request_bounds", "SELECT doc_id, length(text) BETWEEN 1 AND 2000 AS ok FROM documents")
def p12(spark, d):
    return V.read(spark, d, "documents").select("doc_id", F.length("text").between(1, 2000).alias("ok"))


@query("p13_citation_projection", f"WITH {BM25} SELECT query_id, chunk_id, md5(substring(text, 1, 500)) AS text_md5, round(score, 4) AS score FROM bm JOIN v_chunks USING (chunk_id) WHERE rank <= 5", "v_chunks", "v_queries")
def p13(spark, d):
    hits = ranking.cut(bm25(spark, d), 5).join(V.chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    return hits.select("query_id", "chunk_id", F.md5(F.substring("text", 1, 500)).alias("text_md5"), F.round("score", 4).alias("score"))


@query("j1_chunks_documents", "SELECT c.chunk_id, d.filename, d.size_bytes FROM v_chunks c JOIN v_documents d ON d.id = c.doc_id", "v_chunks")
def j1(spark, d):
    return V.chunks(spark, d).join(V.documents(spark, d).select(F.col("id").alias("doc_id"), "filename", "size_bytes"), "doc_id").select("chunk_id", "filename", "size_bytes")


@query("j2_enrichment", f"WITH {VEC} SELECT query_id, v.chunk_id, coalesce(c.page_number, 1) AS page_number, coalesce(md5(c.text), 'none') AS text_md5 FROM vec v LEFT JOIN (SELECT * FROM v_chunks WHERE CAST(doc_id AS BIGINT) % 3 <> 0) c ON c.chunk_id = v.chunk_id WHERE rank <= 50", "v_vectors", "v_chunks")
def j2(spark, d):
    known = V.chunks(spark, d).where("cast(doc_id as bigint) % 3 <> 0").select("chunk_id", "page_number", "text")
    return nearest(spark, d).join(known, "chunk_id", "left").select("query_id", "chunk_id", F.coalesce("page_number", F.lit(1)).alias("page_number"), F.coalesce(F.md5("text"), F.lit("none")).alias("text_md5"))


@query("j4_sibling_expansion", f"WITH {BM25}, top AS (SELECT query_id, b.chunk_id, doc_id FROM bm b JOIN v_chunks USING (chunk_id) WHERE rank <= 10), s AS (SELECT t.query_id, c.chunk_id, row_number() OVER (PARTITION BY t.query_id ORDER BY c.page_number, c.chunk_index, c.chunk_id) AS k FROM (SELECT DISTINCT query_id, doc_id FROM top) t JOIN v_chunks c ON c.doc_id = t.doc_id WHERE NOT EXISTS (SELECT 1 FROM top x WHERE x.query_id = t.query_id AND x.chunk_id = c.chunk_id)) SELECT query_id, chunk_id, CAST(k AS INTEGER) AS rank, 0.1::DOUBLE AS score FROM s WHERE k <= 5", "v_chunks", "v_queries")
def j4(spark, d):
    chunks = V.chunks(spark, d)
    top = ranking.cut(bm25(spark, d), 10).join(chunks.select("chunk_id", "doc_id"), "chunk_id").select("query_id", "chunk_id", "doc_id")
    other = top.select("query_id", "doc_id").distinct().join(chunks, "doc_id").join(top.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("page_number", "chunk_index", "chunk_id"))
    return other.withColumn("rank", rank).where("rank <= 5").select("query_id", "chunk_id", "rank", F.lit(0.1).alias("score"))


@query("t6_evict_oldest", "SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS k FROM embeddings) WHERE k <= 20")
def t6(spark, d):
    w = Window.partitionBy("label").orderBy(F.desc("vec_id"))
    return V.read(spark, d, "embeddings").select("vec_id", F.row_number().over(w).alias("k")).where("k <= 20").select("vec_id")


@query("a11_entity_parts", "SELECT project_id, entity_name, entity_type, synonyms, occurrence_count FROM v_entities", "v_entities")
def a11_parts(spark, d):
    """Entities from the merged parts of three batches of chunks, none of which was counted again."""
    m, parts = V.mentions(spark, d), None
    for batch in range(3):
        new = graph.entity_parts(m.where(F.pmod(F.col("chunk_id"), F.lit(3)) == batch), batch)
        parts = new if parts is None else parts.unionByName(new)
    return graph.entity_totals(parts)


@query("a11_entities", "SELECT project_id, entity_name, entity_type, synonyms[1] AS synonym, occurrence_count, array_to_string(source_chunk_ids, ',') AS chunk_ids FROM v_entities", "v_entities")
def a11(spark, d):
    e = V.entities(spark, d)
    return e.select("project_id", "entity_name", "entity_type", F.col("synonyms")[0].alias("synonym"), "occurrence_count", F.array_join(F.col("source_chunk_ids").cast("array<string>"), ",").alias("chunk_ids"))


_SEEDS = "SELECT n_nationkey AS query_id, n_nationkey % 5 AS project_id, 'Brand#' || (1 + n_nationkey % 5) || (1 + n_nationkey // 5 % 5) AS name FROM nation"


def _names(spark, d):
    k = F.col("n_nationkey")
    name = F.concat(F.lit("Brand#"), 1 + k % 5, 1 + F.floor(k / 5) % 5)
    return V.read(spark, d, "nation").select(k.alias("query_id"), (k % 5).alias("project_id"), name.alias("name"))


_MATCH = (
    f"s AS ({_SEEDS}), m AS (SELECT DISTINCT query_id, e.project_id, entity_name, occurrence_count FROM s JOIN v_entities e ON e.project_id = s.project_id AND (lower(e.entity_name) = lower(s.name) OR lower(e.synonyms[1]) = lower(s.name))), "
    "mr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY occurrence_count DESC, entity_name) AS rank FROM m)"
)


@query("g1_entity_match", f"WITH {_MATCH} SELECT query_id, entity_name, occurrence_count, CAST(rank AS INTEGER) AS rank FROM mr WHERE rank <= 20", "v_entities")
def g1(spark, d):
    return graph.match_entities(_names(spark, d), V.entities(spark, d)).select("query_id", "entity_name", "occurrence_count", "rank")


@query("g1_entity_chunks", f"WITH {_MATCH}, i AS (SELECT query_id, rank AS er, unnest(source_chunk_ids) AS chunk_id, unnest(range(0, len(source_chunk_ids))) AS pos FROM mr JOIN v_entities USING (project_id, entity_name) WHERE rank <= 20), f AS (SELECT query_id, chunk_id, min((er, pos)) AS best FROM i GROUP BY 1, 2), r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY best, chunk_id) AS rank FROM f) SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(1 / rank, 8) AS score FROM r", "v_entities")
def g1c(spark, d):
    e = V.entities(spark, d)
    return graph.entity_chunks(graph.match_entities(_names(spark, d), e), e).select("query_id", "chunk_id", "rank", F.round("score", 8).alias("score"))


_REL = (
    "o AS (SELECT DISTINCT project_id, chunk_id, entity_name FROM v_mentions), n AS (SELECT project_id, entity_name, count(*) AS n FROM o GROUP BY 1, 2), "
    "rel AS (SELECT a.project_id, a.entity_name AS entity_a, b.entity_name AS entity_b, count(*) AS shared_chunks FROM o a JOIN o b ON b.project_id = a.project_id AND b.chunk_id = a.chunk_id AND a.entity_name < b.entity_name GROUP BY 1, 2, 3)"
)


@query("g5_relations", f"WITH {_REL} SELECT r.project_id, entity_a, entity_b, shared_chunks, round(shared_chunks / least(x.n, y.n), 6) AS confidence FROM rel r JOIN n x ON x.project_id = r.project_id AND x.entity_name = entity_a JOIN n y ON y.project_id = r.project_id AND y.entity_name = entity_b", "v_mentions")
def g5(spark, d):
    rel = graph.build_relations(V.mention_ids(spark, d), names=V.entity_names(spark, d))
    return rel.select("project_id", "entity_a", "entity_b", "shared_chunks", F.round("confidence", 6).alias("confidence"))


@query("g5_relations_all", f"WITH {_REL} SELECT project_id, entity_a, entity_b, shared_chunks FROM rel", "v_mentions")
def g5_all(spark, d):
    """The counts alone."""
    return g5(spark, d).drop("confidence")


_STRONG = "WHERE shared_chunks >= 2"


@query("g2_k_hop", f"WITH {_REL}, e AS (SELECT project_id, entity_a AS src, entity_b AS dst FROM rel {_STRONG} UNION ALL SELECT project_id, entity_b, entity_a FROM rel {_STRONG}), s AS (SELECT project_id AS query_id, project_id, min(src) AS name FROM e GROUP BY 1, 2), h1 AS (SELECT DISTINCT query_id, s.project_id, dst FROM s JOIN e ON e.project_id = s.project_id AND e.src = s.name), h2 AS (SELECT DISTINCT query_id, h1.project_id, e.dst FROM h1 JOIN e ON e.project_id = h1.project_id AND e.src = h1.dst), u AS (SELECT query_id, dst, 1 AS depth FROM h1 UNION ALL SELECT query_id, dst, 2 FROM h2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, dst) AS rank FROM u) SELECT query_id, dst AS entity_name, depth, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 30", "v_mentions")
def g2(spark, d):
    rel = stored(graph.build_relations(V.mention_ids(spark, d), names=V.entity_names(spark, d), at_least=2))
    both = rel.select("project_id", F.explode(F.array("entity_a", "entity_b")).alias("entity_name"))
    seeds = both.groupBy("project_id").agg(F.min("entity_name").alias("entity_name")).withColumn("query_id", F.col("project_id"))
    return graph.expand_hops(seeds, rel).select("query_id", "entity_name", "depth", "rank")


@query("g2_k_hop_all", f"WITH {_REL}, e AS (SELECT project_id, entity_a AS src, entity_b AS dst FROM rel {_STRONG} UNION ALL SELECT project_id, entity_b, entity_a FROM rel {_STRONG}), s AS (SELECT project_id AS query_id, project_id, min(src) AS name FROM e GROUP BY 1, 2), h1 AS (SELECT DISTINCT query_id, s.project_id, dst FROM s JOIN e ON e.project_id = s.project_id AND e.src = s.name), h2 AS (SELECT DISTINCT query_id, h1.project_id, e.dst FROM h1 JOIN e ON e.project_id = h1.project_id AND e.src = h1.dst), u AS (SELECT query_id, dst, 1 AS depth FROM h1 UNION ALL SELECT query_id, dst, 2 FROM h2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, dst) AS rank FROM u) SELECT query_id, dst AS entity_name, depth, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 30 AND depth = 2", "v_mentions")
def g2_all(spark, d):
    """What only the second hop reaches, inside the same limit."""
    return g2(spark, d).where("depth = 2")


@query("g2_hops_of_matches", f"WITH {_MATCH}, {_REL}, e AS (SELECT project_id, entity_a AS src, entity_b AS dst FROM rel UNION ALL SELECT project_id, entity_b, entity_a FROM rel), sd AS (SELECT query_id, project_id, entity_name FROM mr WHERE rank <= 20), h1 AS (SELECT DISTINCT query_id, sd.project_id, dst FROM sd JOIN e ON e.project_id = sd.project_id AND e.src = sd.entity_name), h2 AS (SELECT DISTINCT query_id, h1.project_id, e.dst FROM h1 JOIN e ON e.project_id = h1.project_id AND e.src = h1.dst), u AS (SELECT query_id, dst, 1 AS depth FROM h1 UNION ALL SELECT query_id, dst, 2 FROM h2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, dst) AS rank FROM u) SELECT query_id, dst AS entity_name, depth, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 30", "v_mentions", "v_entities")
def g2_matches(spark, d):
    """Names to entities to what is one and two hops away, from mentions alone: no table of relations is built."""
    m = stored(V.mentions(spark, d))
    seeds = graph.match_entities(_names(spark, d), graph.aggregate_entities(m))
    return graph.expand_through_chunks(seeds, m).select("query_id", "entity_name", "depth", "rank")


@query("g3_query_ngrams", r"WITH s AS (SELECT item_id AS query_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark), g AS (SELECT query_id, unnest(w) AS gram FROM s UNION ALL SELECT query_id, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' '))) FROM s UNION ALL SELECT query_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) FROM s) SELECT DISTINCT query_id, gram FROM g")
def g3(spark, d):
    return graph.query_ngrams(V.text_queries(spark, d))


_ENTITY_LIST = (
    r"tm AS (SELECT DISTINCT chunk_id, lower(w) AS e FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '\p{Lu}\p{Ll}{5,}')) AS w FROM v_chunks)), en AS (SELECT e, count(*) AS n, list_sort(list(chunk_id)) AS ids FROM tm GROUP BY 1), "
    r"qg AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS g FROM benchmark), "
    "me AS (SELECT query_id, ids, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, e) AS er FROM qg JOIN en ON e = g), "
    "ei AS (SELECT query_id, er, unnest(ids) AS chunk_id, unnest(range(0, len(ids))) AS pos FROM me WHERE er <= 20), ef AS (SELECT query_id, chunk_id, min((er, pos)) AS best FROM ei GROUP BY 1, 2), "
    "ent AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY best, chunk_id) AS rank FROM ef)"
)
_ANSWER = (
    f"{BM25}, {VEC}, {_ENTITY_LIST}, "
    "l3 AS (SELECT query_id, rank, chunk_id FROM vec WHERE rank <= 50 UNION ALL SELECT query_id, rank, chunk_id FROM bm WHERE rank <= 50 UNION ALL SELECT query_id, rank, chunk_id FROM ent WHERE rank <= 50), "
    "f3 AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 10) AS score FROM l3 WHERE query_id IN (SELECT query_id FROM v_queries) AND query_id IN (SELECT query_id FROM vq) GROUP BY 1, 2), "
    "fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f3), fc AS (SELECT * FROM fr WHERE rank <= 50), "
    r"pw AS (SELECT f.query_id, f.chunk_id, list_distinct(list_filter(regexp_split_to_array(lower(q.query), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS q, list_distinct(regexp_split_to_array(lower(c.text), '[^\p{L}\p{N}_]+')) AS t FROM fc f JOIN v_queries q ON q.query_id = f.query_id JOIN v_chunks c ON c.chunk_id = f.chunk_id), "
    "ps AS (SELECT query_id, chunk_id, round(len(list_intersect(q, t)) / greatest(len(q), 1), 6) AS ps FROM pw), "
    "rr AS (SELECT f.query_id, f.chunk_id, ps AS score, row_number() OVER (PARTITION BY f.query_id ORDER BY ps DESC NULLS LAST, f.rank) AS rank FROM fc f LEFT JOIN ps ON ps.query_id = f.query_id AND ps.chunk_id = f.chunk_id), "
    f"tp AS (SELECT r.*, e.embedding FROM rr r LEFT JOIN v_vectors e ON e.chunk_id = r.chunk_id WHERE r.rank <= 20), mc AS (SELECT t.query_id, t.rank, t.chunk_id, {_UNIT.format('t.embedding')} AS u, {_UNIT.format('q.q')} AS qu FROM tp t JOIN vq q ON q.query_id = t.query_id WHERE t.embedding IS NOT NULL), "
    + MMR.format(k=10)
    + ", np AS (SELECT query_id, count(*) AS n FROM mmr GROUP BY 1), "
    "dv AS (SELECT query_id, rank, chunk_id FROM mmr UNION ALL SELECT t.query_id, coalesce(np.n, 0) + row_number() OVER (PARTITION BY t.query_id ORDER BY t.rank), t.chunk_id FROM tp t LEFT JOIN np ON np.query_id = t.query_id WHERE t.embedding IS NULL), "
    "hs AS (SELECT d.query_id, d.rank, d.chunk_id, coalesce(r.score, 0) AS score FROM dv d JOIN rr r ON r.query_id = d.query_id AND r.chunk_id = d.chunk_id WHERE d.rank <= 10), "
    "pc AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY doc_id) > 3 THEN doc_id || '__p1__parent' || ((row_number() OVER (PARTITION BY doc_id ORDER BY page_number) - 1) // 4) END AS parent_id FROM v_chunks), pt AS (SELECT parent_id, string_agg(text, ' ' ORDER BY chunk_index) AS text FROM pc WHERE parent_id IS NOT NULL GROUP BY 1), "
    "xp AS (SELECT h.query_id, h.rank, coalesce(c.parent_id, h.chunk_id) AS chunk_id, coalesce(p.text, c.text) AS text, h.score, row_number() OVER (PARTITION BY h.query_id, coalesce(c.parent_id, h.chunk_id) ORDER BY h.rank) AS k FROM hs h LEFT JOIN pc c ON c.chunk_id = h.chunk_id LEFT JOIN pt p ON p.parent_id = c.parent_id), "
    "th AS (SELECT *, count(*) FILTER (WHERE score >= 0.05) OVER (PARTITION BY query_id) AS g FROM xp WHERE k = 1), fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM th WHERE score >= 0.05 OR (rank = 1 AND g = 0)) "
    "SELECT f.query_id, CAST(f.r AS INTEGER) AS rank, f.chunk_id, f.score, d.filename, md5(f.text) AS text_md5 FROM fin f LEFT JOIN v_documents d ON d.id = split_part(f.chunk_id, '__', 1) WHERE f.r <= 5"
)


@query("search_end_to_end", f"WITH RECURSIVE {_ANSWER}", "v_chunks", "v_queries", "v_vectors")
def search_end_to_end(spark, d):
    """Vector, lexical and entity lists, fused, reranked, diversified, widened to parents, cut and named."""
    chunks, queries = V.chunks(spark, d), V.text_queries(spark, d)
    entities = stored(graph.aggregate_entities(V.text_mentions(spark, d)))
    words = graph.query_ngrams(queries, 1).select("query_id", F.lit("all").alias("project_id"), F.col("gram").alias("name"))
    by_entity = graph.entity_chunks(graph.match_entities(words, entities), entities)
    named, parents = chunking.parent_groups(chunks.withColumn("page_number", F.lit(1)).withColumn("is_table", F.lit(False)))
    asked = V.vector_queries(spark, d).select("query_id", "query_embedding")
    out = hybrid.answer([nearest(spark, d), bm25(spark, d), by_entity], queries, chunks, V.vectors(spark, d), asked, V.documents(spark, d), named, parents)
    return out.select("query_id", "rank", "chunk_id", "score", "filename", F.md5("text").alias("text_md5"))
