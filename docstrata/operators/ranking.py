"""Ranked lists: fusion, normalisation, thresholds, diversity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranked(scored: DataFrame, *keys: str) -> DataFrame:
    """Ranks from 1 by score inside each list; ties by chunk."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id")))


def fuse(lists: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of (query_id, source, rank, chunk_id): a chunk twice in one list adds twice."""
    total = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (F.lit(RRF_K) + F.col("rank"))), 10).alias("score"))
    return ranked(total, "query_id")


def fuse_subqueries(hits: DataFrame) -> DataFrame:
    """Hits of sub-queries, each a list of its own at rank 1: frequency decides, then the first appearance."""
    total = hits.groupBy("query_id", "chunk_id").agg(F.round(F.count(F.lit(1)) / F.lit(RRF_K + 1), 10).alias("score"), F.min("position").alias("first"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "chunk_id")))


def min_max(scored: DataFrame) -> DataFrame:
    """Scores of each list brought to 0..1; a list without spread divides by 1."""
    w = Window.partitionBy("query_id", "source")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scored.withColumn("score", (F.col("score") - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low))


def weighted_merge(vector: DataFrame, lexical: DataFrame, weight: float = 0.7) -> DataFrame:
    """Normalised scores of two lists, weighted and added over the union of their chunks."""
    v, t = (min_max(x.withColumn("source", F.lit(s))).select("query_id", "chunk_id", F.col("score").alias(s)) for x, s in ((vector, "v"), (lexical, "t")))
    both = v.join(t, ["query_id", "chunk_id"], "full").fillna(0.0, ["v", "t"])
    return ranked(both.select("query_id", "chunk_id", F.round(F.lit(weight) * F.col("v") + F.lit(1 - weight) * F.col("t"), 8).alias("score")), "query_id")


def first_occurrences(lists: DataFrame, *order: str) -> DataFrame:
    """Concatenated lists with each chunk where it stands first."""
    w = Window.partitionBy("query_id", "chunk_id").orderBy(*order)
    return lists.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def threshold(ranked_hits: DataFrame, least: float) -> DataFrame:
    """Hits that reach ``least``; the best hit if none does; all if ``least`` is 0."""
    if least == 0:
        return ranked_hits
    w = Window.partitionBy("query_id")
    good = F.count_if(F.col("score") >= least).over(w)
    return ranked_hits.withColumn("__g", good).where((F.col("score") >= least) | ((F.col("rank") == 1) & (F.col("__g") == 0))).drop("__g")


def cut(ranked_hits: DataFrame, k: int) -> DataFrame:
    return ranked_hits.where(F.col("rank") <= k)


def rerank(candidates: DataFrame, scores: DataFrame, k: int = 20) -> DataFrame:
    """Candidates (query_id, rank, chunk_id) by outside scores (query_id, chunk_id, pair_score); unscored ones follow in their order."""
    joined = candidates.drop("score").join(scores, ["query_id", "chunk_id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("pair_score").desc_nulls_last(), "rank")
    return joined.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k).select("query_id", F.col("new_rank").alias("rank"), "chunk_id", F.col("pair_score").alias("score"))


def diversify(candidates: DataFrame, k: int = 20, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance (Carbonell and Goldstein 1998) of each query's bounded candidates.

    ``candidates``: query_id, rank, chunk_id, score, embedding, query_embedding. The earlier candidate wins a tie, those
    without an embedding follow, and a query of which none has one keeps its order.
    """
    kind = {c: candidates.schema[c].dataType.simpleString() for c in ("query_id", "chunk_id")}

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        has = frame[frame["embedding"].notna()]
        rest = frame[frame["embedding"].isna()]
        picked: list[int] = []
        if len(has):
            m = np.array(has["embedding"].tolist(), dtype=np.float64)
            n = np.linalg.norm(m, axis=1, keepdims=True)
            m = m / np.where(n == 0, 1, n)
            q = frame["query_embedding"].iloc[0]
            if q is None:
                relevance = has["score"].to_numpy() / (has["score"].max() or 1.0)
            else:
                q = np.array(q, dtype=np.float64)
                relevance = m @ (q / (np.linalg.norm(q) or 1.0))
            nearest = np.zeros(len(m))
            free = np.ones(len(m), bool)
            while len(picked) < min(k, len(m)):
                value = np.where(free, weight * relevance - (1 - weight) * nearest, -np.inf)
                best = int(np.flatnonzero(value >= value.max() - 1e-12)[0])
                free[best] = False
                near = m @ m[best]
                nearest = near if not picked else np.maximum(nearest, near)
                picked.append(best)
        order = [*has["chunk_id"].iloc[picked], *rest["chunk_id"]][:k]
        return pd.DataFrame({"query_id": key[0], "rank": range(1, len(order) + 1), "chunk_id": order})

    return candidates.groupBy("query_id").applyInPandas(run, f"query_id {kind['query_id']}, rank int, chunk_id {kind['chunk_id']}")
