"""Places where a model plugs in: texts to vectors, and (query, text) pairs to scores. Callables run on Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.functions import text as T


def hashed_features(texts: list[str], dims: int = 64) -> np.ndarray:
    """A stand-in for an embedding model: signed counts of hashed words, normalised."""
    out = np.zeros((len(texts), dims), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % dims] += 1 if h >> 63 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n == 0, 1, n)


def embedded(df: DataFrame, text_col: str, embed: Callable[[list[str]], np.ndarray] = hashed_features, column: str = "embedding") -> DataFrame:
    def run(texts: pa.Array) -> pa.Array:
        rows = embed([t or "" for t in texts.to_pylist()])
        if len(rows) != len(texts):
            raise ValueError("the embedding function must give a vector for each text")
        return pa.array(list(rows), pa.list_(pa.float32()))

    return df.withColumn(column, F.arrow_udf(run, "array<float>")(text_col))


def embedded_with_cache(df: DataFrame, text_col: str, cache: DataFrame, provider: str, model: str, embed=hashed_features) -> tuple[DataFrame, DataFrame]:
    """Vectors from the cache (cache_key, embedding) where they are, from the function for distinct misses; and those misses."""
    keyed = df.withColumn("cache_key", T.cache_key(F.lit(provider), F.lit(model), F.col(text_col)))
    missing = keyed.join(cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"]).select("cache_key", text_col)
    new = embedded(missing, text_col, embed).select("cache_key", "embedding")
    return keyed.join(cache.select("cache_key", "embedding").unionByName(new), "cache_key"), new


def overlap_score(query: Column, text: Column) -> Column:
    """The default pair score: the share of the query's distinct words that the text has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(query), words(text))) / F.greatest(F.size(words(query)), F.lit(1))


def pair_scores(candidates: DataFrame, score: Callable[[list[str], list[str]], list[float]] | None = None) -> DataFrame:
    """``pair_score`` of candidates (query, text): the overlap, or a function of two lists of texts."""
    if score is None:
        return candidates.withColumn("pair_score", overlap_score(F.col("query"), F.col("text")))

    def run(q: pa.Array, t: pa.Array) -> pa.Array:
        return pa.array(score(q.to_pylist(), t.to_pylist()), pa.float64())

    return candidates.withColumn("pair_score", F.arrow_udf(run, "double")("query", "text"))
