"""The registered queries of the training-data operators, over whole tables; SQL where DuckDB can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm import bpe, conversation_trie, exact_search, html_text, media, packing, piece_bpe, pii, secrets, sharding, spelling, toxicity
from docstrata.llm.ngram_join import jaccard_components


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.kd_shards(_read(spark, sf_dir, "documents"), shards=16)
    return shards.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op8_html_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").alias("n_chars"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(_read(spark, sf_dir, "documents"))


def op2_toxicity_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_on_labels(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, score_col="score")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_read(spark, sf_dir, "documents"))


def op4_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_read(spark, sf_dir, "documents"))


def op5_secret_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_read(spark, sf_dir, "documents"))


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(_read(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"))


def op10_m_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.document_variants(_read(spark, sf_dir, "documents"))


def op12_piece_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digest(_read(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie_nodes(_read(spark, sf_dir, "conversations"))


def queries() -> dict:
    found = [op1_kd_tree_sharding, op2_toxicity_compression, op3_best_fit_packing, op4_pii_weak_supervision, op5_secret_randomness_battery, op6_audio_features, op7_ngram_jaccard_join, op8_html_layout_text, op9_bpe_round_trip, op10_m_tree_search, op11_spelling_variants, op12_piece_bpe_round_trip, op13_conversation_trie]
    return {f.__name__: f for f in found}


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def _crc32_sql(hexadecimal: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of bytes written in hexadecimal; ``steps.t`` is the table of its 256 steps."""
    return f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length({hexadecimal}) // 2), lambda i: CAST('0x' || substr({hexadecimal}, 2 * i + 1, 2) AS BIGINT))),
    lambda a, b: xor(t[1 + (xor(a, b) & 255)], a >> 8)), 4294967295)"""


_CRC32_STEPS = """steps AS (
  SELECT list(x ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x FROM range(256) r(b)))"""


OP11_SQL = rf"""
WITH {_CRC32_STEPS},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
  unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS c, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY id, run),
hashed AS (
  SELECT run, c, {_crc32_sql("x")} AS h FROM counted, steps),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, c FROM hashed),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
holes AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS w, b.n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN v b ON a.rest = b.word),
best AS (
  SELECT v.word, any_value(v.n) AS n, count(near.w) AS n_near, first(near.w ORDER BY near.n DESC, encode(near.w)) AS w, max(near.n) AS m
  FROM v LEFT JOIN near ON near.word = v.word GROUP BY v.word),
formed AS (SELECT word, n, n_near, CASE WHEN m >= 2 * n THEN w END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM best),
chain AS (
  WITH RECURSIVE c(word, z) AS (SELECT word, word FROM formed UNION ALL SELECT c.word, f.form FROM c JOIN formed f ON f.word = c.z WHERE f.form IS NOT NULL)
  SELECT c.word, c.z AS root FROM c JOIN formed f ON f.word = c.z WHERE f.form IS NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word
"""


OP13_SQL = rf"""
WITH {_CRC32_STEPS},
t AS (
  SELECT conv_id, k, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS r FROM (
    SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, {_crc32_sql("x")} % 4 AS h FROM (SELECT DISTINCT conv_id, hex(encode(CAST(conv_id AS VARCHAR))) AS x FROM t), steps),
b AS (
  SELECT c.conv_id, 0 AS part, r, k, words FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND r <= h
  UNION ALL SELECT conv_id, 1, r, k, words FROM t JOIN c USING (conv_id) WHERE r > h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, r) AS d, k, words FROM b),
p AS (
  SELECT conv_id, d, md5(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key, words FROM s UNION ALL SELECT conv_id, 0, '', 0 FROM c),
longest AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
nodes AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM p GROUP BY key, d),
linked AS (SELECT n.*, u.key AS up FROM nodes n LEFT JOIN p u ON u.conv_id = n.conv_id AND u.d = n.d - 1),
kids AS (SELECT up AS key, count(*) AS kids FROM linked WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT p.key, sum((n.n - 1) * n.words) AS saved, count(*) FILTER (WHERE k.kids IS NULL) AS leaves
  FROM nodes n LEFT JOIN kids k ON k.key = n.key JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.key),
ends AS (SELECT p.key, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM p JOIN longest USING (conv_id, d) GROUP BY p.key)
SELECT l.conv_id, l.d AS depth, u.conv_id AS parent_conv_id, l.n AS n_convs, coalesce(k.kids, 0) AS n_children, b.leaves AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM linked l LEFT JOIN nodes u ON u.key = l.up LEFT JOIN kids k ON k.key = l.key JOIN below b ON b.key = l.key LEFT JOIN ends e ON e.key = l.key
"""


def oracle_sql() -> dict:
    return {"op13_conversation_trie": OP13_SQL, "op11_spelling_variants": OP11_SQL, "op10_m_tree_search": OP10_SQL, "op7_ngram_jaccard_join": OP7_SQL}
