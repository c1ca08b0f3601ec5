"""Exact top-k by inner product with an M-tree.

Inner products become distances: a stored vector gets one more coordinate, so that all have the length of the longest,
and a query gets 0 there; the nearest are then those of the highest product. Vectors are dealt to pages by their
nearest pivot; a page is an M-tree node with its pivot, covering radius and leaves, each leaf has a routing object, a
radius and its distance to the pivot, and each entry its distance to the routing object. A search enters pages, and the
leaves of a page, in the order of their least possible distance and skips what those stored distances exclude. Each query
first searches the pages of its own pivot; the k-th score found there bounds its search of all others.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.shared import forget, table
from docstrata.sources.shared import shared_folder

_PAGE = (
    "page long, dims int, pivot binary, radius double, ids binary, vectors binary, leaf_ends binary, routes binary, route_radius binary, route_parent binary, entry_parent binary"
)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``vec_id`` and whole-number components; rows without an id, a vector, or with a component that is no number go."""
    x = F.col(vector_col)
    good = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))
    return vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column, dims: int) -> np.ndarray:
    """Rows as float64, missing components 0. Products are exact while they stay below 2**53."""
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _lifted(m: np.ndarray, top: float) -> np.ndarray:
    return np.c_[m, np.sqrt(np.maximum(top - (m * m).sum(1), 0))]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _paged(dims: int, top: float, leaf_rows: int):
    """One page: leaves around routing objects that lie far apart."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        ids, m = frame["vec_id"].to_numpy(np.int64), _matrix(frame["v"], dims)
        full = _lifted(m, top)
        pivot = full[[0]]
        to_pivot = _distances(full, pivot)[:, 0]
        wanted = -(-len(ids) // leaf_rows)
        chosen, near = [int(to_pivot.argmax())], _distances(full, full[[int(to_pivot.argmax())]])[:, 0]
        while len(chosen) < wanted and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, _distances(full, full[[chosen[-1]]])[:, 0])
        to_routes = _distances(full, full[chosen])
        home = to_routes.argmin(1)
        order, ends, routes, radius, parent, entry = [], [], [], [], [], []
        for j, c in enumerate(chosen):
            own = np.flatnonzero(home == j)
            for at in range(0, len(own), 2 * leaf_rows):
                part = own[at : at + 2 * leaf_rows]
                order.append(part)
                ends.append(len(part))
                routes.append(full[c])
                radius.append(to_routes[part, j].max())
                parent.append(to_pivot[c])
                entry.append(to_routes[part, j])
        order = np.concatenate(order)
        raw = lambda x, kind: np.ascontiguousarray(x, kind).tobytes()
        return pd.DataFrame([{
            "page": key[0], "dims": dims, "pivot": raw(pivot, "f8"), "radius": float(to_pivot.max()), "ids": raw(ids[order], "i8"), "vectors": raw(m[order], "i8"),
            "leaf_ends": raw(np.cumsum(ends), "i8"), "routes": raw(routes, "f8"), "route_radius": raw(radius, "f8"), "route_parent": raw(parent, "f8"), "entry_parent": raw(np.concatenate(entry), "f8"),
        }])

    return run


class _Best:
    """The k best (score, id) of each query of a block; ties go to the smaller id."""

    def __init__(self, rows: int, k: int):
        self.k, self.score, self.id = k, np.full((rows, k), -np.inf), np.full((rows, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray):
        s = np.concatenate([self.score[rows], score], 1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, score.shape)], 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def worst(self, rows: np.ndarray) -> np.ndarray:
        return self.score[rows, -1]


def search_page(page: dict, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, norm: np.ndarray, floor: np.ndarray, best: _Best):
    """Best-first search of one page for the queries at ``rows``; ``floor`` is a score each query's k-th best reaches at least."""
    dims = page["dims"]
    f8, i8 = (lambda n, kind=kind: np.frombuffer(page[n], kind) for kind in ("f8", "i8"))

    def reach(some: np.ndarray) -> np.ndarray:  # distance beyond which nothing counts; a little more than it, for rounding
        least = np.maximum(best.worst(some), floor[some])
        d = np.sqrt(np.maximum(norm[some] - 2 * np.where(np.isinf(least), 0, least), 0))
        return np.where(np.isinf(least), np.inf, d * (1 + 1e-9) + 1e-6)

    to = lambda some, objects: np.sqrt(np.maximum(norm[some][:, None] - 2 * queries[some] @ objects[:, :dims].T, 0))
    to_pivot = to(rows, f8("pivot").reshape(1, dims + 1))[:, 0]
    open_rows = to_pivot - page["radius"] <= reach(rows)
    rows, to_pivot = rows[open_rows], to_pivot[open_rows]
    if not len(rows):
        return
    routes, radius, parent = f8("routes").reshape(-1, dims + 1), f8("route_radius"), f8("route_parent")
    ends, ids, vectors, entry = i8("leaf_ends"), i8("ids"), i8("vectors").reshape(-1, dims).astype(np.float64), f8("entry_parent")
    # bounds from stored distances alone; only then a distance to the routing object
    least = np.maximum(np.abs(to_pivot[:, None] - parent[None]) - radius[None], 0)
    open_ = (least <= reach(rows)[:, None]).any(0)
    to_route = np.full(least.shape, np.nan)
    to_route[:, open_] = to(rows, routes[open_])
    least[:, open_] = np.maximum(least[:, open_], to_route[:, open_] - radius[open_])
    least[:, ~open_] = np.inf
    for leaf in np.argsort(least.min(0), kind="stable"):
        limit = reach(rows)
        at = np.flatnonzero(least[:, leaf] <= limit)
        if not len(at):
            continue
        span = slice(int(ends[leaf - 1]) if leaf else 0, int(ends[leaf]))
        may = np.abs(to_route[at, leaf][:, None] - entry[span][None]) <= limit[at][:, None]
        columns = np.flatnonzero(may.any(0))
        some = rows[at[may.any(1)]]
        if not len(columns) or not len(some):
            continue
        own = ids[span][columns]
        score = queries[some] @ vectors[span][columns].T
        score[own[None] == query_ids[some][:, None]] = -np.inf
        score[score < floor[some][:, None]] = -np.inf
        best.add(some, score, own)


def _far_apart(m: np.ndarray, wanted: int) -> np.ndarray:
    """Rows that lie far apart, each the one furthest from those before it."""
    chosen = [0]
    near = _distances(m, m[[0]])[:, 0]
    while len(chosen) < wanted and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(m, m[[chosen[-1]]])[:, 0])
    return m[chosen]


_HITS = "query_id long, vec_id long, score long"
_QUERY_BYTES = 32 << 20  # of one chunk of queries


def _searcher(shared, k: int, own: bool, block_rows: int):
    """Pages of a task, in batches, to the best k rows that they hold for each query of a chunk.

    ``own``: queries meet the pages of their own cell, else those of all others.
    """

    def run(batches):
        ids, queries, norm, cells, floor = shared.value
        best = _Best(len(ids), k)
        for batch in batches:
            pages = batch.to_pylist()
            dims = queries.shape[1]
            pivots = np.stack([np.frombuffer(p["pivot"], np.float64) for p in pages])
            radius = np.array([p["radius"] for p in pages])
            for at in range(0, len(ids), block_rows):
                rows = np.arange(at, min(at + block_rows, len(ids)))
                least = np.sqrt(np.maximum(norm[rows][:, None] - 2 * queries[rows] @ pivots[:, :dims].T, 0)) - radius
                meets = (cells[rows][:, None] == np.array([p["page"] >> 32 for p in pages])[None]) == own
                for i in np.argsort(np.where(meets, least, np.inf).min(0), kind="stable"):
                    some = rows[meets[:, i]]
                    if len(some):
                        search_page(pages[i], some, ids, queries, norm, floor, best)
        at, place = np.nonzero(np.isfinite(best.score))
        for first in range(0, len(at), 1 << 16):
            a, b = at[first : first + (1 << 16)], place[first : first + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(best.id[a, b]), pa.array(best.score[a, b].astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0,
    pivots: int | None = None, sample_rows: int = 4096, page_rows: int = 1024, leaf_rows: int = 32, block_rows: int = 256, chunk_queries: int | None = None,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the k highest inner products of each query row.

    ``queries`` says which rows of ``vectors`` are queries; all rows but those with the query's own id are candidates.
    Exact; ties go to the smaller id; with fewer than k candidates all are returned. Rows whose id or vector is null,
    or which hold a null, NaN or infinite component, take no part; vectors shorter than the longest count 0 in the
    missing places; repeated rows are candidates each; an empty table, or no queries, gives an empty result. Other columns
    are not read.

    Pivots are fitted on a bounded sample (``sample_rows`` by hash of the id; by default one pivot for a page's rows, at
    most as many as the sample has); every row is indexed. Queries go in chunks of bounded bytes, each broadcast once for
    its own pages and once, with the scores reached there, for all others; a page is read twice for a chunk.
    """
    spark = vectors.sparkSession
    rows, rows_path = table(quantised(vectors, id_col, vector_col, scale).withColumn("is_query", F.coalesce(queries, F.lit(False))))
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    facts = rows.agg(F.max(F.size("v")).alias("dims"), F.max(norm).alias("top"), F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).first()
    if not facts["n"] or not facts["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, top = facts["dims"], facts["top"]
    sample = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id", "v").limit(sample_rows).collect()
    wanted = pivots or max(1, min(sample_rows, facts["n"] // page_rows))
    pivot_m = _far_apart(_lifted(_matrix([r["v"] for r in sample], dims), top), wanted)

    def nearest(v: pa.Array) -> pa.Array:
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(v), 1024):
            found.append(_distances(_lifted(_matrix(v[at : at + 1024].to_pylist(), dims), top), pivot_m).argmin(1))
        return pa.array(np.concatenate(found))

    dealt, dealt_path = table(rows.withColumn("cell", F.arrow_udf(nearest, "long")("v")))
    cells = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / page_rows).alias("cuts"))  # as many rows as pivots
    salted = dealt.join(F.broadcast(cells), "cell").select(
        "vec_id", "v", (F.col("cell") * 2**32 + F.pmod(F.xxhash64("vec_id", "v", F.lit(9)), F.col("cuts"))).alias("page")
    )
    pages, pages_path = table(salted.groupBy("page").applyInPandas(_paged(dims, top, leaf_rows), _PAGE))
    asked, asked_path = table(dealt.where("is_query").select("vec_id", "v", "cell").distinct())
    forget(spark, rows_path, dealt_path)

    chunk = chunk_queries or max(1, _QUERY_BYTES // (8 * max(1, dims)))
    rounds = -(-facts["q"] // chunk)
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda hits: hits.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    result = f"{shared_folder(spark)}/docstrata-{uuid.uuid4().hex}"
    for r in range(rounds):
        part = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(rounds)) == r).orderBy("cell", "vec_id").collect()  # about ``chunk`` rows
        if not part:
            continue
        ids, m, cell = np.array([x["vec_id"] for x in part]), _matrix([x["v"] for x in part], dims), np.array([x["cell"] for x in part])
        lengths, floor = (m * m).sum(1) + top, np.full(len(ids), -np.inf)
        own = spark.sparkContext.broadcast((ids, m, lengths, cell, floor))
        first, first_path = table(ranked(pages.mapInArrow(_searcher(own, k, True, block_rows), _HITS)))
        reached = {x["query_id"]: float(x["score"]) for x in first.where(F.col("rank") == k).select("query_id", "score").collect()}
        own.unpersist()
        floor = np.array([reached.get(int(i), -np.inf) for i in ids])
        others = spark.sparkContext.broadcast((ids, m, lengths, cell, floor))
        second = pages.mapInArrow(_searcher(others, k, False, block_rows), _HITS)
        ranked(first.drop("rank").unionByName(second)).write.mode("append").parquet(result)
        others.unpersist()
        forget(spark, first_path)
    forget(spark, pages_path, asked_path)
    return spark.read.schema("query_id long, vec_id long, score long, rank int").parquet(result).select("query_id", "rank", "vec_id", "score")
