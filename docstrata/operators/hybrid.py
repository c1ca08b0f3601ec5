"""The whole search of many queries: lists to fused candidates, rerank, diversity, parents, threshold, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.operators import chunking, plugins, ranking
from docstrata.sources.shared import stored


def answer(
    lists: list[DataFrame], queries: DataFrame, chunks: DataFrame, embeddings: DataFrame, query_embeddings: DataFrame, documents: DataFrame, named: DataFrame, parents: DataFrame, *,
    candidates: int = 50, reranked: int = 20, diverse: int = 10, least: float = 0.05, k: int = 5, score=None,
) -> DataFrame:
    """``query_id``, ``rank``, ``chunk_id``, ``score``, ``filename``, ``text`` of the k sources of each query.

    ``lists`` are ranked lists (query_id, rank, chunk_id), cut to ``candidates`` each and fused by reciprocal ranks.
    ``queries`` (query_id, query) with a row in ``query_embeddings`` (query_id, query_embedding) are answered. The fused
    candidates get pair scores (``score``: a function of texts, or word overlap), and the best ``reranked`` of them are put
    in an order of relevance and diversity; chunks give way to their parents (``named`` and ``parents`` as
    ``chunking.parent_groups`` gives them), hits below ``least`` go unless they are all, and documents add their names.
    """
    asked = queries.join(query_embeddings.select("query_id"), "query_id", "left_semi")
    cut = [ranking.cut(x, candidates).select("query_id", F.lit(str(i)).alias("source"), "rank", "chunk_id") for i, x in enumerate(lists)]
    all_lists = cut[0]
    for x in cut[1:]:
        all_lists = all_lists.unionByName(x)
    fused = stored(ranking.cut(ranking.fuse(all_lists.join(asked, "query_id", "left_semi")), candidates))
    texts = fused.join(asked, "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    scores = plugins.pair_scores(texts, score).select("query_id", "chunk_id", F.round("pair_score", 6).alias("pair_score"))
    top = stored(ranking.rerank(fused, scores, reranked))
    spread = ranking.diversify(top.join(embeddings.select("chunk_id", "embedding"), "chunk_id", "left").join(query_embeddings.select("query_id", "query_embedding"), "query_id"), diverse)
    hits = spread.join(top.select("query_id", "chunk_id", F.coalesce("score", F.lit(0.0)).alias("score")), ["query_id", "chunk_id"])
    whole = ranking.threshold(chunking.expand_to_parents(hits, named, parents), least)
    placed = whole.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)
    names = documents.select(F.col("id").alias("doc_id"), "filename")
    return placed.withColumn("doc_id", F.substring_index("chunk_id", "__", 1)).join(names, "doc_id", "left").select("query_id", "rank", "chunk_id", "score", "filename", "text")
