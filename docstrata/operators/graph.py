"""Entities, their aliases and relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.sources.shared import remove, stored, stored_at, swept


def aggregate_entities(mentions: DataFrame) -> DataFrame:
    """Mentions by project and exact name: how often, chunk ids in order, type and synonym of the first mention."""
    seen = F.struct("chunk_id", "seq")
    return mentions.groupBy("project_id", "entity_name").agg(
        F.min_by("entity_type", seen).alias("entity_type"), F.array(F.min_by("synonym", seen)).alias("synonyms"), F.count(F.lit(1)).alias("occurrence_count"),
        F.sort_array(F.collect_set("chunk_id")).alias("source_chunk_ids"),
    )


def entity_parts(mentions: DataFrame, batch: int, *, most: int = 1_000) -> DataFrame:
    """What a batch of mentions adds to its entities, in rows that never hold more than ``most`` chunk ids.

    Columns: project_id, entity_name, batch, part, first (the place of the first mention), entity_type, synonym, occurrence_count, source_chunk_ids.
    Mentions are pre-aggregated by chunk, then dealt to parts by the chunk's hash, so an entity that a third of all
    chunks mention is many rows of bounded size, made in many tasks. Parts of several batches merge by a union; a batch that is run
    again takes the place of its own rows. A chunk is to be in one batch.
    """
    seen = F.struct("chunk_id", "seq")
    keys = ["project_id", "entity_name"]
    by_chunk = mentions.groupBy(*keys, "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "entity_type", "synonym")).alias("own"))
    by_chunk = stored(by_chunk)
    cuts = by_chunk.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) * 2 / F.lit(most)).alias("cuts"))
    dealt = by_chunk.join(cuts, keys).withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("cuts")))
    place = F.struct("chunk_id", F.col("own.seq").alias("seq"))
    parts = dealt.groupBy(*keys, "part").agg(
        F.min(place).alias("first"), F.min_by("own.entity_type", place).alias("entity_type"), F.min_by("own.synonym", place).alias("synonym"),
        F.sum("n").alias("n"), F.sort_array(F.collect_list("chunk_id")).alias("ids"),
    )
    slices = F.transform(F.sequence(F.lit(0), ((F.size("ids") - 1) / most).cast("int")), lambda i: F.slice("ids", i * most + 1, F.lit(most)))
    rows = parts.select(*keys, F.lit(batch).alias("batch"), "part", "first", "entity_type", "synonym", "n", F.posexplode(slices).alias("slice", "source_chunk_ids"))
    return rows.select(*keys, "batch", "part", "slice", "first", "entity_type", "synonym", F.when(F.col("slice") == 0, F.col("n")).otherwise(F.lit(0)).alias("occurrence_count"), "source_chunk_ids")


def entity_totals(parts: DataFrame) -> DataFrame:
    """``aggregate_entities`` of all batches without the chunk ids: partial sums alone, so no row grows with an entity."""
    return parts.groupBy("project_id", "entity_name").agg(
        F.min_by("entity_type", "first").alias("entity_type"), F.array(F.min_by("synonym", "first")).alias("synonyms"), F.sum("occurrence_count").alias("occurrence_count")
    )


def aliases(entities: DataFrame) -> DataFrame:
    """Names and synonyms in lower case, a row each: what an equality join can use in place of an OR over arrays."""
    both = F.array_distinct(F.transform(F.array_union(F.array("entity_name"), "synonyms"), F.lower))
    return entities.select("project_id", "entity_name", "occurrence_count", F.explode(both).alias("alias"))


def query_ngrams(queries: DataFrame, most: int = 3) -> DataFrame:
    """Distinct word n-grams (1 to ``most`` words) of queries, in lower case."""
    words = F.filter(F.split(F.lower("query"), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def of(n: int):
        joined = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
        return F.when(F.size("w") >= n, joined).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*map(of, range(1, most + 1))))
    return queries.withColumn("w", words).select("query_id", F.explode(F.array_distinct(grams)).alias("gram"))


def match_entities(names: DataFrame, entities: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, project_id, name) to its k most frequent entities known by that name or synonym."""
    hits = names.withColumn("alias", F.lower("name")).join(aliases(entities), ["project_id", "alias"])
    once = hits.select("query_id", "project_id", "entity_name", "occurrence_count").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("occurrence_count"), "entity_name")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def entity_chunks(matched: DataFrame, entities: DataFrame) -> DataFrame:
    """Chunks of matched entities in the order of entities and of their ids, once each; score 1 / position."""
    ids = matched.join(entities.select("project_id", "entity_name", "source_chunk_ids"), ["project_id", "entity_name"]).select("query_id", F.col("rank").alias("entity_rank"), F.posexplode("source_chunk_ids").alias("pos", "chunk_id"))
    first = ids.groupBy("query_id", "chunk_id").agg(F.min(F.struct("entity_rank", "pos")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at.entity_rank", "at.pos", "chunk_id")
    return first.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "chunk_id", (1 / F.col("rank")).alias("score"))


_CHUNK = ["project_id", "chunk_id"]


def _sides(sized: DataFrame, block: int) -> tuple[DataFrame, bool]:
    """Mentions (project_id, chunk_id, entity_name, n) as rows whose pairs are to be listed, and whether any has a ``w``.

    A chunk of up to ``block`` entities is a row with all of them in ``v``, in order. A longer one is cut into blocks by hash: a row
    for each block, and one for each two blocks with the other's in ``w``, dealt to tasks on their own.
    """
    entity, rows = F.struct("entity_name", "n"), sized.count()
    dealt = sized.repartition(max(8, rows // 250_000), *_CHUNK).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(*_CHUNK)))
    whole = dealt.where(F.col("m") <= block).groupBy(*_CHUNK).agg(F.sort_array(F.collect_list(entity)).alias("v"))
    whole = whole.select("project_id", "v", F.lit(None).cast(whole.schema["v"].dataType).alias("w"), F.size("v").alias("m"))
    short = stored_at(whole, "zstd")[0]
    if (short.agg(F.sum("m")).first()[0] or 0) == rows:
        return short, False
    long = dealt.where(F.col("m") > block).withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    long = long.withColumn("s", F.pmod(F.xxhash64("entity_name"), "blocks").cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("s", "t"), F.greatest("s", "t")
    parts = long.select(*_CHUNK, low.alias("i"), high.alias("j"), (F.col("s") == low).alias("own"), entity.alias("e"))
    parts = parts.repartition(max(8, rows // 250_000), *_CHUNK, "i", "j").groupBy(*_CHUNK, "i", "j")
    parts = parts.agg(*(F.sort_array(F.collect_list(F.when(side, F.col("e")))).alias(k) for k, side in (("v", F.col("own")), ("w", ~F.col("own")))))
    return short.unionByName(stored_at(parts.select("project_id", "v", F.when(F.col("i") < F.col("j"), F.col("w")).alias("w"), F.lit(0).alias("m")), "zstd")[0]), True


def _listed(sides: DataFrame, across: bool) -> DataFrame:
    """The pairs of ``_sides``, each as often as chunks have it: project_id, entity_a, n_a, entity_b, n_b, and a hash of the pair."""
    inside = sides.where("w is null").select("project_id", F.posexplode("v").alias("k", "a"), "v").select("project_id", "a", F.explode(F.slice("v", F.col("k") + 2, F.size("v"))).alias("b"))
    if across:
        other = sides.where("w is not null").select("project_id", F.explode("v").alias("x"), "w").select("project_id", "x", F.explode("w").alias("y"))
        inside = inside.unionByName(other.select("project_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    flat = inside.select("project_id", *(F.col(f"{s}.{c}").alias(f"{d}_{s}") for s in "ab" for c, d in (("entity_name", "entity"), ("n", "n"))))
    return flat.withColumn("pair", F.xxhash64("project_id", "entity_a", "entity_b"))


def build_relations(mentions: DataFrame, *, names: DataFrame | None = None, at_least: int = 1, block: int = 64, most: int = 2_000_000) -> DataFrame:
    """Pairs of entities that share ``at_least`` so many chunks: how many, and their share of the rarer one's chunks.

    All chunks count. Chunks of more than ``block`` entities are cut into blocks by hash, and each pair of blocks is listed on its own, so that no task lists a chunk's pairs alone.
    With ``names`` (entity_id, entity_name) the mentions have an ``entity_id`` instead of a name, and those without a name relate nothing.

    Names travel with mentions and not with pairs. Pairs are counted by a hash of eight bytes first; one whose hash
    comes once is in one chunk, and is told where the chunk is. Only pairs whose hash comes again are gathered by their names, so the counts
    are exact whatever hashes meet. Beyond ``most`` such hashes, which a broadcast should not hold, all pairs are gathered by name.
    Runs at once, in steps that leave a table of chunks; what each has shuffled goes when it ends.
    """
    spark, own = mentions.sparkSession, "entity_name" if names is None else "entity_id"
    with swept(spark):
        once, path = stored_at(mentions.select(*_CHUNK, own).distinct())
        size = once.groupBy("project_id", own).agg(F.count(F.lit(1)).alias("n"))
        size = size if names is None else size.join(names, own)
        sized, after = stored_at(once.dropna().join(size, ["project_id", own]).select(*_CHUNK, "entity_name", "n"))
        remove(spark, path)
        pairs = _listed(*_sides(sized, block))
        remove(spark, after)
        again = stored(pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("pair"))
        few = again.count() <= most
    met = pairs.join(F.broadcast(again), "pair", "left_semi") if few else pairs
    shared = met.groupBy("project_id", "entity_a", "entity_b").agg(F.count(F.lit(1)).alias("shared_chunks"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    if at_least > 1:
        shared = shared.where(F.col("shared_chunks") >= at_least)
    elif few:
        shared = shared.unionByName(pairs.join(F.broadcast(again), "pair", "left_anti").drop("pair").withColumn("shared_chunks", F.lit(1).cast("long")))
    return shared.select("project_id", "entity_a", "entity_b", F.lit("mentioned_alongside").alias("relation"), "shared_chunks", (F.col("shared_chunks") / F.least("n_a", "n_b")).alias("confidence"))


def nearest_names(edges: DataFrame, k: int = 30) -> DataFrame:
    """Of each source's edges (project_id, src, dst) the ``k`` whose other end comes first by name, once each.

    Each task keeps no more of a source than that before the shuffle, so a hub costs what any other entity costs.
    """
    order = Window.partitionBy("project_id", "src").orderBy("dst")
    return edges.withColumn("__n", F.dense_rank().over(order)).where(F.col("__n") <= k).drop("__n").distinct()


def _two_hops(seeds: DataFrame, near: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """The first ``k`` entities of each query by depth and name; ``near`` gives the first ``k`` neighbours of those reached.

    The first ``k`` names of a union are among the first ``k`` of each of its parts, so a query has at most ``k`` rows after
    a hop, and ``k`` times ``k`` while it takes one. Queries that the first hop fills take no second.
    """
    query = Window.partitionBy("query_id")

    def step(at: DataFrame, depth: int) -> DataFrame:
        reached = at.join(near(at).withColumnRenamed("src", "entity_name"), ["project_id", "entity_name"]).select("query_id", "project_id", F.col("dst").alias("entity_name")).distinct()
        first = F.row_number().over(query.orderBy("entity_name", "project_id"))
        return reached.withColumn("__n", first).where(F.col("__n") <= k).select("query_id", "project_id", "entity_name", F.lit(depth).alias("depth"))

    one = stored(step(seeds.select("query_id", "project_id", "entity_name"), 1))
    open_queries = one.withColumn("__n", F.count(F.lit(1)).over(query)).where(F.col("__n") < k).select("query_id", "project_id", "entity_name")
    found = one.unionByName(step(open_queries, 2))
    order = query.orderBy("depth", "entity_name", "project_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def expand_hops(seeds: DataFrame, relations: DataFrame, k: int = 30) -> DataFrame:
    """Entities one and two hops from the seeds of each query (query_id, project_id, entity_name), nearest first.

    Edges are walked both ways as equality joins; a seed that is met again on the second hop is returned. Each entity is cut
    to its first ``k`` neighbours before any hop is taken.
    """
    relations = relations.select("project_id", "entity_a", "entity_b")
    ends = F.explode(F.array(F.struct(F.col("entity_a").alias("src"), F.col("entity_b").alias("dst")), F.struct(F.col("entity_b").alias("src"), F.col("entity_a").alias("dst"))))
    heads = stored(nearest_names(relations.select("project_id", ends.alias("e")).select("project_id", "e.src", "e.dst"), k))
    return _two_hops(seeds, lambda _: heads, k)


def expand_through_chunks(seeds: DataFrame, mentions: DataFrame, k: int = 30, *, shared: int = 1) -> DataFrame:
    """``expand_hops`` over the relations of ``shared`` chunks and more, without building relations that no hop needs.

    A hop reads the chunks of the entities it starts from and counts what else those mention. Rows without a project, a
    chunk or an entity relate nothing; seeds that no chunk mentions reach nothing.
    """
    once = stored(mentions.select("project_id", "chunk_id", "entity_name").dropna().distinct())

    def near(at: DataFrame) -> DataFrame:
        own = once.join(at.select("project_id", "entity_name").distinct(), ["project_id", "entity_name"]).withColumnRenamed("entity_name", "src")
        beside = own.join(once, ["project_id", "chunk_id"]).where("src <> entity_name")
        counted = beside.groupBy("project_id", "src", F.col("entity_name").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
        return nearest_names(counted.where(F.col("n") >= shared).drop("n"), k)

    return _two_hops(seeds, near, k)
