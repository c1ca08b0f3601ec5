"""Vector search and similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions import text as T
from docstrata.sources.shared import stored

QUERY_BYTES = 32 << 20  # of the vectors of one round of queries, as float64
QUERIES_AT_ONCE = 512  # rows of a matrix of scores
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


class _Nearest:
    """The k best so far of each query of a round, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.rows: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, object))] * queries
        self.floor = np.full(queries, -np.inf)  # the k-th score, once there are k

    def add(self, first: int, score: np.ndarray, names: np.ndarray) -> None:
        """Scores of queries from ``first`` on (-inf: no hit) with vectors of these ids."""
        for i in np.flatnonzero((score >= self.floor[first : first + len(score), None]).any(axis=1) & np.isfinite(score).any(axis=1)):
            q, own = first + i, score[i]
            keep = np.flatnonzero((own >= self.floor[q]) & np.isfinite(own))
            value, name = np.concatenate([self.rows[q][0], own[keep]]), np.concatenate([self.rows[q][1], names[keep]])
            if len(value) > self.k:
                least = np.partition(value, len(value) - self.k)[len(value) - self.k]
                sure, tied = np.flatnonzero(value > least), np.flatnonzero(value == least)
                tied = sorted(tied.tolist(), key=lambda j: (name[j] is not None, name[j]))[: self.k - len(sure)]
                best = np.concatenate([sure, np.array(tied, np.int64)])
                value, name = value[best], name[best]
            if len(value) == self.k:
                self.floor[q] = value.min()
            self.rows[q] = value, name


def exact_top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 50, same_project: bool = False, id_col: str = "chunk_id") -> DataFrame:
    """The k nearest vectors by cosine of each query: query_id, rank, ``id_col``, score.

    ``queries`` has query_id, query_embedding (and query_project). Rows of zero norm, and without vector or id, are skipped. Queries go in
    rounds of at most ``QUERY_BYTES``; each round is broadcast, read once over all vectors, written, and given up before the next.
    A task keeps k hits for each query of a round over all its vectors, so what it passes on does not grow with them;
    one window merges the tasks.
    """
    spark = vectors.sparkSession
    usable = queries.where(T.norm(F.col("query_embedding")) > 0)
    total, dims = usable.agg(F.count(F.lit(1)), F.max(F.size("query_embedding"))).first()
    rounds = max(1, -(-total * 8 * (dims or 1) // QUERY_BYTES))
    project = F.col("query_project") if same_project else F.lit(None)
    block = usable.select("query_id", "query_embedding", project.cast("string").alias("query_project"), F.pmod(F.xxhash64("query_id"), F.lit(rounds)).alias("round"))
    kind, query_kind = vectors.schema[id_col].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    scope = F.col("project_id") if same_project else F.lit(None)
    source = vectors.where(F.col(id_col).isNotNull() & F.col("embedding").isNotNull()).select(id_col, "embedding", scope.cast("string").alias("project"))
    found = None
    for r in range(rounds):
        rows = block.where(F.col("round") == r).collect()  # about QUERY_BYTES
        if not rows:
            continue
        ids = np.array([x["query_id"] for x in rows], dtype=object)
        q = np.array([x["query_embedding"] for x in rows], dtype=np.float64)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        scopes = np.array([x["query_project"] for x in rows], dtype=object)
        shared = spark.sparkContext.broadcast((ids, q, scopes))

        def run(batches, shared=shared, kinds=(_ARROW[query_kind], _ARROW[kind])):
            ids, q, scopes = shared.value
            best = _Nearest(len(q), k)
            for batch in batches:
                m = np.array(batch.column(1).to_pylist(), dtype=np.float64)
                if not len(m):
                    continue
                n = np.linalg.norm(m, axis=1)
                unit = (m / np.where(n == 0, 1, n)[:, None]).T
                names = np.array(batch.column(0).to_pylist(), dtype=object)
                project = np.array(batch.column(2).to_pylist(), dtype=object)
                for first in range(0, len(q), QUERIES_AT_ONCE):
                    some = slice(first, first + QUERIES_AT_ONCE)
                    score = np.round(q[some] @ unit, 8)
                    keep = np.broadcast_to(n > 0, score.shape)
                    if same_project:
                        keep = keep & (scopes[some, None] == project[None])
                    best.add(first, np.where(keep, score, -np.inf), names)
            for first in range(0, len(q), QUERIES_AT_ONCE):
                hits = [(ids[i], *best.rows[i]) for i in range(first, min(first + QUERIES_AT_ONCE, len(q))) if len(best.rows[i][0])]
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array([i for i, value, _ in hits for _ in value], kinds[0]), id_col: pa.array([x for _, _, name in hits for x in name], kinds[1]),
                    "score": pa.array([x for _, value, _ in hits for x in value], pa.float64()),
                })

        part = source.mapInArrow(run, f"query_id {query_kind}, {id_col} {kind}, score double")
        if rounds > 1:
            part = stored(part)
            shared.unpersist()
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.select("query_id").limit(0).crossJoin(vectors.select(id_col).limit(0)).withColumn("score", F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def wrong_dimensions(vectors: DataFrame, dims: int) -> DataFrame:
    return vectors.where(F.coalesce(F.size("embedding"), F.lit(-1)) != dims)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, not anew for each element that ``body`` visits."""
    return F.transform(F.array(value), body)[0]


def _unit(v: Column) -> Column:
    scaled = lambda w, n: F.transform(w, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))
    return _bound(v, lambda w: _bound(T.norm(w), lambda n: scaled(w, n)))


def blended(query: Column, hypotheses: Column, alpha: float = 0.5) -> Column:
    """Mean of hypothetical vectors, normalised, blended with the query's vector, and normalised again."""
    total = F.aggregate(hypotheses, F.transform(query, lambda x: F.lit(0.0)), lambda acc, h: F.zip_with(acc, h, lambda a, b: a + b.cast("double")))
    return _unit(F.zip_with(query, _unit(total), lambda q, m: q.cast("double") * (1 - alpha) + m * alpha))


ROUTED_AT_ONCE = 4_096  # vectors that a task sends to regions at once
PIVOT_SAMPLE, MOST_PIVOTS = 2_048, 256  # most vectors that pivots are drawn from (those of the smallest hashes), most pivots


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Vectors far from one another: each next one is the farthest from those before."""
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 1e-12:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _regions(vectors: DataFrame, threshold: float, id_col: str, block_rows: int) -> DataFrame:
    """Rows (project_id, dims, region, guest, id, embedding): each vector at home in one region, and a guest in those later
    regions of which some vector may be near enough."""
    spark = vectors.sparkSession
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("project_id", id_col)}
    known = stored(
        vectors.where(F.col("project_id").isNotNull() & F.col(id_col).isNotNull() & F.col("embedding").isNotNull())
        .select("project_id", F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dims"))
    )
    common = known.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").first()
    if common is None:
        return known.select("project_id", "dims", F.lit(0).alias("region"), F.lit(False).alias("guest"), "id", "embedding")
    dims, most = common["dims"], max(1, min(MOST_PIVOTS, -(-common["n"] // block_rows) * 4))
    drawn = known.where(F.col("dims") == dims).orderBy(F.xxhash64("id")).limit(PIVOT_SAMPLE).select("embedding").collect()
    pivots = _pivots(_unit_rows(np.array([r["embedding"] for r in drawn], np.float64).reshape(len(drawn), -1)), most)
    shared = spark.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS vectors

    def distances(column: pa.Array) -> np.ndarray:
        m = _unit_rows(np.array(column.to_pylist(), np.float64))
        p = shared.value
        return np.sqrt(np.maximum((m**2).sum(1)[:, None] - 2 * m @ p.T + (p**2).sum(1), 0))

    def home(batches):
        for part in batches:
            if part.num_rows:
                d = distances(part.column("embedding"))
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(d[np.arange(len(d)), at])], names=["region", "away"])

    usual = known.where(F.col("dims") == dims)
    radius = np.full(len(pivots), -np.inf)
    for r in usual.select("embedding").mapInArrow(home, "region int, away double").groupBy("region").agg(F.max("away").alias("far")).collect():  # a row for each pivot
        radius[r["region"]] = r["far"]
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6  # of unit vectors whose cosine is the threshold
    apart = np.sqrt(np.maximum(2 - 2 * np.clip(pivots @ pivots.T, -1, 1), 1e-12)) if len(pivots) > 1 else np.ones((1, 1))

    def route(batches):
        for part in batches:
            if not part.num_rows:
                continue
            d = distances(part.column("embedding"))
            at = d.argmin(1)
            own = d[np.arange(len(d)), at]
            beyond = (d**2 - own[:, None] ** 2) / (2 * apart[at])  # how far the border to another region is
            to = (beyond <= reach) & (d <= radius + reach) & (np.arange(d.shape[1]) > at[:, None])
            to[np.arange(len(d)), at] = True
            rows, regions = np.nonzero(to)
            for first in range(0, len(rows), ROUTED_AT_ONCE):
                row, region = rows[first : first + ROUTED_AT_ONCE], regions[first : first + ROUTED_AT_ONCE]
                again = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [again.column("project_id"), again.column("dims"), pa.array(region, pa.int32()), pa.array(region != at[row], pa.bool_()), again.column("id"), again.column("embedding")],
                    names=["project_id", "dims", "region", "guest", "id", "embedding"],
                )

    schema = f"project_id {kinds['project_id']}, dims int, region int, guest boolean, id {kinds[id_col]}, embedding array<double>"
    rest = known.where(F.col("dims") != dims).select("project_id", "dims", F.lit(-1).alias("region"), F.lit(False).alias("guest"), "id", "embedding")
    return usual.mapInArrow(route, schema).unionByName(rest)


def near_pairs(vectors: DataFrame, threshold: float, id_col: str = "id", *, block_rows: int = 1024) -> DataFrame:
    """Pairs within a project whose cosine reaches the threshold: project_id, a, b (a < b), score.

    Unit vectors of that cosine are at most a certain distance apart. Vectors belong to the region of the nearest of some
    pivots; one is compared within its region, and with a later region only if the border between the two pivots and the ball around the
    other's vectors leave room for a vector at that distance. So regions that cannot hold a pair never meet. A region
    of more than ``block_rows`` vectors of a project is dealt out in blocks by hash, and each pair of blocks is multiplied in a task of its
    own that lists only what reaches the threshold; no task holds more than about two blocks.
    """
    return _near_pairs(vectors, threshold, id_col, block_rows)[0]


def near_pairs_with_work(vectors: DataFrame, threshold: float, id_col: str = "id", *, block_rows: int = 1024) -> tuple[DataFrame, DataFrame]:
    """``near_pairs``, and one row of ``compared`` and ``all_pairs``: pairs that were multiplied, and pairs in all projects."""
    return _near_pairs(vectors, threshold, id_col, block_rows)


def _near_pairs(vectors: DataFrame, threshold: float, id_col: str, block_rows: int) -> tuple[DataFrame, DataFrame]:
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("project_id", id_col)}
    keys = ["project_id", "dims", "region"]
    rows = stored(_regions(vectors, threshold, id_col, block_rows))
    # a table with a row for each region of each project
    sizes = stored(rows.groupBy(*keys).agg(F.count_if(~F.col("guest")).alias("own"), F.count_if("guest").alias("guests")))
    blocks = sizes.where("own > 0").select(*keys, F.ceil(F.col("own") / block_rows).alias("own_blocks"), F.ceil(F.col("guests") / block_rows).alias("guest_blocks"))
    placed = rows.join(blocks, keys).withColumn(
        "s", F.when(F.col("guest"), F.col("own_blocks") + F.pmod(F.xxhash64("id"), F.greatest(F.col("guest_blocks"), F.lit(1)))).otherwise(F.pmod(F.xxhash64("id"), F.col("own_blocks")))
    )
    # vectors at home meet all blocks, guests those of vectors at home
    last = F.when(F.col("guest"), F.col("own_blocks") - 1).otherwise(F.col("own_blocks") + F.col("guest_blocks") - 1)
    dealt = placed.withColumn("t", F.explode(F.sequence(F.lit(0), last.cast("int")))).select(*keys, F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), "s", "id", "embedding")

    schema = f"project_id {kinds['project_id']}, a {kinds[id_col]}, b {kinds[id_col]}, score double"

    def run(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of 256 vectors with a block at a time."""
        parts = pa.Table.from_batches(parts)
        i, j = key[3].as_py(), key[4].as_py()
        m = _unit_rows(parts.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(parts.num_rows, -1))
        ids = parts.column("id").to_numpy()
        s = parts.column("s").to_numpy()
        own = np.nonzero(s == i)[0]
        other = own if i == j else np.nonzero(s == j)[0]
        for first in range(0, len(own), 256):
            score = m[own[first : first + 256]] @ m[other].T
            x, y = np.nonzero(score >= threshold - 1e-6)  # Spark rounds and decides
            a, b, score = ids[own[first + x]], ids[other[y]], score[x, y]
            keep = a < b if i == j else a != b
            a, b, score = a[keep], b[keep], score[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0].as_py()] * len(a), key[0].type), pa.array(np.where(a < b, a, b), parts.schema.field("id").type), pa.array(np.where(a < b, b, a), parts.schema.field("id").type), pa.array(score)],
                names=["project_id", "a", "b", "score"],
            )

    pairs = dealt.groupBy(*keys, "i", "j").applyInArrow(run, schema)
    pairs = pairs.withColumn("score", F.round("score", 6)).where(F.col("score") >= threshold)
    own = F.col("own").cast("double")
    compared = sizes.agg(F.coalesce(F.sum(own * (own - 1) / 2 + own * F.col("guests")), F.lit(0.0)).alias("compared"))
    every = sizes.groupBy("project_id", "dims").agg(F.sum(own).alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("all_pairs"))
    return pairs, compared.crossJoin(every)  # one row each
