"""Structures that outlive a call: vector index, pruned postings, committed tables, cache replay."""

import random
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstrata.operators import block_max, cache_replay, chunking, drafts, graph, lexical, sessions, vector_index, vectors
from docstrata.sources import committed, hash_store
from docstrata.sources import views as V


def pairs(df):
    return {(r["query_id"], r["chunk_id"]) for r in df.collect()}


def test_vector_index_recall_reuse_and_deletes(spark, tmp_path, monkeypatch):
    sf = "/root/testdata/sf0.1"
    v, asked = V.vectors(spark, sf), V.vector_queries(spark, sf)
    folder = vector_index.build(v.where("chunk_no % 4 <> 1"), f"file://{tmp_path}/index")
    vector_index.append(folder, v.where("chunk_no % 4 = 1"), 2)
    exact = pairs(vectors.exact_top_k(v, asked, k=20))
    found = pairs(vector_index.search(folder, asked))
    assert len(exact & found) / len(exact) >= 0.9
    monkeypatch.setattr(vector_index, "PART_ROWS", 10)  # cells in several parts
    again = pairs(vector_index.search(folder, asked.where("query_id < 40")))
    assert again == {x for x in found if x[0] < 40}
    vector_index.delete(folder, v.where("chunk_no % 5 = 0"), 2)
    left = pairs(vectors.exact_top_k(v.where("chunk_no % 5 <> 0"), asked, k=20))
    now = pairs(vector_index.search(folder, asked))
    assert not now & pairs(v.where("chunk_no % 5 = 0").select(F.lit(1).alias("query_id"), "chunk_id")) and len(left & now) / len(left) >= 0.9
    vector_index.append(folder, v.where("chunk_no % 10 = 0"), 3)  # some come back
    assert any(int(c.split("__")[0]) % 10 == 0 for _, c in pairs(vector_index.search(folder, asked)))
    to = f"file://{tmp_path}/compacted"
    vector_index.compact(spark, folder, to)
    assert pairs(vector_index.search(to, asked)) == pairs(vector_index.search(folder, asked))
    assert spark.read.parquet(f"{to}/lists").count() == v.where("chunk_no % 10 <> 5").count()


def test_vector_index_edges(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=6).tolist()) for i in range(300)] + [(300, [0.0] * 6), (301, None), (302, [float("nan")] + [1.0] * 5), (None, [1.0] * 6), (303, [None] + [1.0] * 5)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(50)]  # equal vectors
    v = spark.createDataFrame(rows, "vec long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (2, [0.0] * 6), (3, None)], "query_id long, query_embedding array<float>")
    folder = vector_index.build(v, id_col="vec", k=10)
    got = vector_index.search(folder, q, k=10, id_col="vec", id_type="bigint").orderBy("rank").collect()
    assert [(x["query_id"], x["vec"], x["score"]) for x in got] == [(1, 1000 + i, 1.0) for i in range(10)]
    assert vector_index.search(folder, q.limit(0), id_col="vec", id_type="bigint").count() == 0
    assert vector_index.approximate_top_k(v.limit(0), q, id_col="vec").count() == 0
    with pytest.raises(Exception, match="in an index of 6"):
        vector_index.append(folder, spark.createDataFrame([(1, [1.0])], "vec long, embedding array<float>"), 2, id_col="vec")
    with pytest.raises(ValueError):
        vector_index.fit(v.limit(0), id_col="vec")


def hits(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


def test_block_max_equals_the_plain_search(spark):
    r = random.Random(3)
    topics = [[f"{t}{i}" for i in range(40)] for t in ("alpha", "beta", "gamma", "delta", "eps")]
    texts = [" ".join(r.choices(topics[i % 5], k=r.randint(1, 60)) + r.choices(["the", "of", "and"], k=r.randint(0, 9))) for i in range(600)]
    texts += [None, "", "...", "alpha1 " * 5_000, "Alpha1 alpha2", "Alpha1 alpha2"]
    chunks = spark.createDataFrame([(f"c{i}", t, "x") for i, t in enumerate(texts)], "chunk_id string, text string, term string")
    asked = ["alpha1", "alpha1 alpha2", "beta3 beta4 beta5 beta6 the of", "gamma1 delta1", " ", "nothing here at all known", "the and of", " ".join(topics[4][:20])]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    folder = block_max.build(chunks, range_chunks=8)
    for k in (3, 50):
        found, work = block_max.search_with_work(spark, folder, queries, k)
        assert hits(found) == hits(lexical.search_texts(chunks, queries, k))
        done = {x["query_id"]: (x["blocks"], x["scored"]) for x in work.collect()}
        assert all(0 < scored <= blocks for blocks, scored in done.values())
        if k == 3:
            assert sum(s for _, s in done.values()) < sum(b for b, _ in done.values())  # the rest cannot reach the third score
    gone = chunks.where("chunk_id LIKE '%7' OR chunk_id = 'c603'")
    block_max.delete(spark, folder, gone, 1)
    more = spark.createDataFrame([("n1", "alpha1 beta3 gamma1", ""), ("c7", "alpha1 again", ""), ("n2", None, "")], chunks.schema)
    block_max.append(folder, more, 2, range_chunks=2)
    now = chunks.join(gone.select("chunk_id"), "chunk_id", "left_anti").unionByName(more)
    assert hits(block_max.search(spark, folder, queries, 10)) == hits(lexical.search_texts(now, queries, 10))
    assert hits(block_max.search(spark, folder, queries.limit(0))) == []
    empty = block_max.build(chunks.limit(0))
    assert hits(block_max.search(spark, empty, queries)) == []


def table_rows(df):
    return sorted(map(tuple, df.collect()))


def test_committed_table_rewrites_only_what_it_must(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/docs", "id long, name string, size int"
    rows = {i: (i, f"n{i}", i % 50) for i in range(0, 2_000, 2)}
    first = committed.create(folder, spark.createDataFrame(list(rows.values()), schema), "id", file_rows=100)
    assert len(first.files) == 10 and table_rows(committed.read(spark, folder)) == sorted(rows.values())
    new = [(4, "four", 1), (5, "five", 2), (5_000, "far", 3)]
    second = committed.upsert(spark, folder, spark.createDataFrame(new, schema), file_rows=100)
    rows |= {r[0]: r for r in new}
    assert table_rows(committed.read(spark, folder)) == sorted(rows.values())
    assert len(set(first.files) & set(second.files)) == 9  # one file held key 4; 5 and 5000 are new
    third = committed.delete(spark, folder, spark.createDataFrame([(6,), (7,), (None,), (1_998,)], "id long"))
    for k in (6, 1_998):
        del rows[k]
    assert table_rows(committed.read(spark, folder)) == sorted(rows.values()) and len(set(second.files) & set(third.files)) >= 8
    assert committed.delete(spark, folder, spark.createDataFrame([(7,), (99_999,)], "id long")).version == 2  # nothing to do
    assert table_rows(committed.read(spark, folder, 0)) == sorted((i, f"n{i}", i % 50) for i in range(0, 2_000, 2))
    with pytest.raises(ValueError):
        committed.upsert(spark, folder, spark.createDataFrame([(1, "a", 1), (1, "b", 1)], schema))
    with pytest.raises(committed.Conflict):
        committed.create(folder, spark.createDataFrame([], schema), "id")
    assert committed.vacuum(spark, folder, keep=1) >= 2 and table_rows(committed.read(spark, folder)) == sorted(rows.values())


def test_committed_table_has_one_winner(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/docs", "id string, part int, v int"
    make = lambda *r: spark.createDataFrame(list(r), schema)
    committed.create(folder, make(*((f"k{i:03d}", 0, i) for i in range(100))), "id", "part", file_rows=20)
    ours, same, other, twice = (committed.prepare_upsert(spark, folder, make(r)) for r in (("k005", 0, -1), ("k006", 0, -2), ("k095", 0, -3), ("zz", 1, -4)))
    again = committed.prepare_upsert(spark, folder, make(("zz", 1, -5)))
    reader = committed.read(spark, folder)
    assert committed.commit(spark, folder, ours).version == 1
    with pytest.raises(committed.Conflict):
        committed.commit(spark, folder, same)  # the same file
    assert committed.commit(spark, folder, other).version == 2  # other files: on top
    assert committed.commit(spark, folder, twice).version == 3
    with pytest.raises(committed.Conflict):
        committed.commit(spark, folder, again)  # a key that the winner has added
    want = {(f"k{i:03d}", 0): i for i in range(100)} | {("k005", 0): -1, ("k095", 0): -3, ("zz", 1): -4}
    assert table_rows(committed.read(spark, folder)) == sorted((*k, v) for k, v in want.items())
    assert table_rows(reader) == sorted((f"k{i:03d}", 0, i) for i in range(100))  # a reader keeps its version
    empty = f"file://{tmp_path}/empty"
    committed.create(empty, make(), "id", "part")
    assert committed.read(spark, empty).count() == 0
    committed.upsert(spark, empty, make(("a", 1, 1)))
    committed.delete(spark, empty, make(("a", 1, 1)).select("id", "part"))
    assert committed.read(spark, empty).count() == 0


@pytest.mark.parametrize("capacity,block", [(1, 7), (5, 13), (40, 64), (200, 50), (1_000, 300)])
def test_cache_replay_equals_a_sequential_cache(spark, capacity, block):
    r = random.Random(capacity)
    keys = [f"k{min(r.randint(0, 300), r.randint(0, 300))}" if r.random() > 0.02 else None for _ in range(2_500)] + ["hot"] * 400 + [f"k{i}" for i in range(300)]
    log = list(zip(r.sample(range(100_000), len(keys)), keys))
    cache, want = OrderedDict(), []
    for at, key in sorted(log):
        hit, out = key in cache, None
        if key is not None:
            cache[key] = at
            cache.move_to_end(key)
            if len(cache) > capacity:
                out = cache.popitem(last=False)[0]
        want.append((at, key, hit, out))
    rows = spark.createDataFrame(log, "at int, key string")
    got = cache_replay.replay(rows, capacity, block_rows=block).collect()
    assert sorted((x["at"], x["key"], x["hit"], x["evicted"]) for x in got) == want
    assert sorted((x["key"], x["at"]) for x in cache_replay.contents(rows, capacity).collect()) == sorted(cache.items())
    assert cache_replay.replay(rows.limit(0), capacity).collect() == []


def test_context_sizes_of_all_keys(spark):
    names = [(f"My-{key.upper()}:latest", next(size for k, size in sessions.CONTEXT_SIZES if k in key)) for key, _ in sessions.CONTEXT_SIZES] + [("other", 32_768)]
    assert len(names) == 20
    got = spark.createDataFrame(names, "model string, want int").withColumn("got", sessions.context_size(F.col("model"))).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_sections_of_document_types(spark):
    docs = spark.createDataFrame([(1, "# User stories\na\n## Goals\nb\n# Non-functional specifications\nc\n# Key findings\nd\n# Stakeholders\ne")], "doc_id int, text string")
    ids = lambda kind: [r["section_id"] for r in drafts.sections(docs, kind).orderBy("section_no").collect()]
    assert ids("PRD") == ["user_stories", "goals", "functional_specs", "key_findings", "stakeholders"]  # the first title that the heading holds
    assert ids("unknown") == ids("custom") == ["user_stories", "goals", "non_functional_specifications", "key_findings", "stakeholders"]
    assert ids("brd")[-1] == "stakeholders" and drafts.signatures(docs, "brd").count() == 8
    assert [len(drafts.template(k)) for k in ("brd", "sow", "prd", "letter")] == [8, 7, 7, 4]


def test_exact_search_keeps_k_hits_of_a_query_in_a_task(spark, monkeypatch):
    rows = [(f"v{i:05d}", [1.0, 2.0], 1) for i in range(20_000)] + [("a", [2.0, 1.0], 1), ("zero", [0.0, 0.0], 1), (None, [1.0, 2.0], 1), ("none", None, 1)]
    v = spark.createDataFrame(rows, "chunk_id string, embedding array<double>, project_id int").repartition(3)
    q = spark.createDataFrame([(i, [1.0, 2.0 + i], 1) for i in range(40)], "query_id int, query_embedding array<double>, query_project int")
    want = [(i, n + 1, f"v{n:05d}") for i in range(40) for n in range(5)]
    for size in (32 << 20, 200):  # one round of queries, and several
        monkeypatch.setattr(vectors, "QUERY_BYTES", size)
        got = vectors.exact_top_k(v, q, k=5)
        assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in got.collect()) == want
    best = vectors._Nearest(2, 3)
    names = np.array([f"n{i}" for i in range(9)], object)
    best.add(0, np.array([[0.5] * 9, [-np.inf] * 9]), names[::-1])
    best.add(0, np.array([[0.4, 0.5, 0.9] * 3, [-np.inf, 0.1, -np.inf] * 3]), np.array([f"m{i}" for i in range(9)], object))
    assert sorted(best.rows[0][1]) == ["m2", "m5", "m8"] and sorted(best.rows[1][1]) == ["m1", "m4", "m7"]


def test_near_pairs_by_regions(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 16))
    m = np.concatenate([centres[r.integers(0, 12, 700)] + 0.15 * r.normal(size=(700, 16)), np.repeat(r.normal(size=(1, 16)), 60, 0), np.zeros((2, 16))])
    rows = [(int(i % 3), i, x.tolist()) for i, x in enumerate(m)] + [(0, 900, [1.0, 0.0]), (0, 901, [2.0, 0.0]), (0, 902, None), (None, 903, m[0].tolist())]
    v = spark.createDataFrame(rows, "project_id int, id int, embedding array<double>")
    u = m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    for threshold, share in ((0.95, 0.5), (0.2, 1.0), (-0.1, 1.0)):
        want = {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if i % 3 == j % 3 and round(float(u[i] @ u[j]), 6) >= threshold} | {(900, 901)}
        found, work = vectors.near_pairs_with_work(v, threshold, block_rows=32)
        assert {(x["a"], x["b"]) for x in found.collect()} == want and found.count() == len(want)
        done = work.first()
        assert 0 < done["compared"] <= share * done["all_pairs"]
    assert vectors.near_pairs(v.limit(0), 0.5).count() == 0


def test_hash_store_answers_and_reads_few_buckets(spark, tmp_path):
    import hashlib

    folder = f"file://{tmp_path}/history"
    sha = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    batch = lambda ids: spark.createDataFrame([(None if i is None else sha(i),) for i in ids], "file_hash string")
    names = {sha(i): i for i in range(20_000)}
    got = lambda ids, n: sorted(names[r["file_hash"]] for r in hash_store.add(spark, folder, batch(ids), n).collect())
    assert got([*range(3_000), None, 5, 5], 0) == list(range(3_000))
    assert got(range(2_000, 4_000), 1) == list(range(3_000, 4_000))
    assert got(range(2_000, 4_000), 1) == list(range(3_000, 4_000))  # run again
    assert hash_store.compact(spark, folder, bucket_rows=100) == 64  # 4,000 hashes
    assert got([10, 3_500, 4_001, 4_002], 2) == [4_001, 4_002]
    assert got([4_001, 9_000], 3) == [9_000]
    assert hash_store.compact(spark, folder, bucket_rows=100) == 64
    assert got(range(3_990, 4_010), 4) == [4_000, *range(4_003, 4_010)]
    assert got([], 5) == []
    # filters: nearly all buckets of unseen hashes stay unread
    filters = spark.read.parquet(f"{folder}/{hash_store._generation(spark, folder)[0]}/filters").where("batch = -1").collect()
    unseen = [sha(i) for i in range(10_000, 12_000)]
    wrong = 0
    for f in filters:
        bits = np.unpackbits(np.frombuffer(bytes(f["filter"]), np.uint8))
        mine = [h for h in unseen if int(h[:15], 16) >> 54 == f["bucket"]]
        wrong += int(bits[hash_store._probes(mine, f["places"])].all(axis=1).sum()) if mine else 0
    assert len(filters) == 64 and wrong < 40


def test_entity_parts_merge(spark):
    r = random.Random(6)
    rows = [("p", "hot", "T", f"s{i % 3}", i, i % 2) for i in range(500)] + [(r.choice("pq"), f"e{r.randint(0, 20)}", r.choice("TU"), "s", r.randint(0, 400), r.randint(0, 3)) for _ in range(800)]
    rows = list({(x[0], x[1], x[4]): x for x in rows}.values())  # a chunk mentions an entity once
    schema = "project_id string, entity_name string, entity_type string, synonym string, chunk_id int, seq int"
    batches = [spark.createDataFrame([x for x in rows if x[4] % 3 == b], schema) for b in range(3)]
    kept = None
    for b, mentions in enumerate(batches):
        new = graph.entity_parts(mentions, b, most=40)
        kept = new if kept is None else kept.unionByName(new)
    assert max(len(x["source_chunk_ids"]) for x in kept.collect()) <= 40
    whole = graph.aggregate_entities(spark.createDataFrame(rows, schema))
    told = lambda df: sorted((x["project_id"], x["entity_name"], x["entity_type"], tuple(x["synonyms"]), x["occurrence_count"]) for x in df.collect())
    assert told(graph.entity_totals(kept)) == told(whole)
    lists = {}
    for x in kept.collect():
        lists.setdefault((x["project_id"], x["entity_name"]), []).extend(x["source_chunk_ids"])
    assert {k: sorted(v) for k, v in lists.items()} == {(x["project_id"], x["entity_name"]): sorted(x["source_chunk_ids"]) for x in whole.collect()}
    again = graph.entity_parts(batches[1], 1, most=40)  # a batch that is run again replaces itself
    assert told(graph.entity_totals(kept.where("batch <> 1").unionByName(again))) == told(whole)


def two_hops(edges, seeds, k):
    """The first k of (depth, name) of each query, from a dict of neighbours."""
    out = set()
    for query, names in seeds.items():
        one = {y for x in names for y in edges.get(x, ())}
        two = {y for x in one for y in edges.get(x, ())}
        out |= {(query, n, d, i + 1) for i, (d, n) in enumerate(sorted([(1, n) for n in one] + [(2, n) for n in two])[:k])}
    return out


@pytest.mark.parametrize("k", [3, 30])
def test_hops_over_a_hub(spark, k):
    r = random.Random(4)
    chunks = {f"hub{i}": ["hub", f"spoke{i:04}"] for i in range(600)} | {f"c{i}": r.sample([f"e{j:02}" for j in range(40)] + ["hub"], 3) for i in range(30)} | {"alone": ["x"], "couple": ["y", "z"]}
    edges = {}
    for v in chunks.values():
        for a in v:
            edges.setdefault(a, set()).update(set(v) - {a})
    seeds = {0: ["hub"], 1: ["e01", "e02"], 2: ["y"], 3: ["x"], 4: ["nobody"], 5: ["spoke0001", "y", "e03"], 6: sorted(edges)}
    m = spark.createDataFrame([(1, e, c) for c, v in chunks.items() for e in v * 2] + [(1, None, "couple"), (None, "y", "couple"), (1, "y", None)], "project_id int, entity_name string, chunk_id string")
    asked = spark.createDataFrame([(q, 1, n) for q, names in seeds.items() for n in names] + [(7, 2, "y"), (8, None, "y")], "query_id int, project_id int, entity_name string")
    rows = lambda df: sorted((x["query_id"], x["entity_name"], x["depth"], x["rank"]) for x in df.collect())
    relations = graph.build_relations(m)
    assert rows(graph.expand_hops(asked, relations, k)) == rows(graph.expand_through_chunks(asked, m, k)) == sorted(two_hops(edges, seeds, k))
    twice = relations.unionByName(relations)  # relations that are told twice are walked once
    assert rows(graph.expand_hops(asked, twice, k)) == sorted(two_hops(edges, seeds, k))
    assert graph.expand_through_chunks(asked, m.limit(0), k).count() == graph.expand_through_chunks(asked.limit(0), m, k).count() == 0
    strong = relations.where("shared_chunks >= 2")
    assert rows(graph.expand_through_chunks(asked, m, k, shared=2)) == rows(graph.expand_hops(asked, strong, k))


def test_a_hub_is_cut_before_the_shuffle_and_between_hops(spark, monkeypatch):
    edges = spark.range(0, 20_000, 1, 4).select(F.lit(1).alias("project_id"), F.lit("hub").alias("src"), F.format_string("s%05d", "id").alias("dst"))
    heads = graph.nearest_names(edges, 30)
    assert "WindowGroupLimit" in heads._jdf.queryExecution().executedPlan().toString()
    assert [x["dst"] for x in heads.orderBy("dst").collect()] == [f"s{i:05}" for i in range(30)]
    kept = []
    monkeypatch.setattr(graph, "stored", lambda df: kept.append(df.count()) or df)
    seeds = spark.createDataFrame([(q, 1, "s00007") for q in range(5)], "query_id int, project_id int, entity_name string")
    got = graph.expand_hops(seeds, edges.select("project_id", F.col("src").alias("entity_a"), F.col("dst").alias("entity_b")))
    assert got.count() == 5 * 30  # the hub, then its first 29 neighbours
    assert kept == [30 + 20_000, 5]  # each spoke's one edge, 30 of the hub's 20,000; one row of each query between the hops


@pytest.mark.parametrize("most", [0, 100_000])
def test_names_do_not_travel_with_pairs(spark, most):
    from itertools import combinations

    r = random.Random(6)
    names = {i: [f"{'long name ' * 20}{r.random():.6f} {i:03}"] for i in range(60)}
    names[7].append("another name of 7")
    del names[9]  # has no name
    chunks = {(p, c): set(r.sample(range(60), r.choice([1, 2, 3, 20]))) for p in (1, 2) for c in range(40)} | {(1, 99): {3}, (2, 99): {3, 4}}
    ids = [(p, c, i) for (p, c), v in chunks.items() for i in v for _ in range(r.choice([1, 2]))]
    m = spark.createDataFrame(ids + [(1, None, 3), (1, None, 4), (None, 5, 3), (None, 5, 4), (1, 5, None)], "project_id int, chunk_id long, entity_id long")
    known = spark.createDataFrame([(i, n) for i, v in names.items() for n in v], "entity_id long, entity_name string")
    shared, own = {}, {}
    for (p, _), v in [*chunks.items(), ((1, None), {3, 4})]:
        told = sorted(n for i in v for n in names.get(i, []))
        for n in told:
            own[p, n] = own.get((p, n), 0) + 1
        for pair in combinations(told, 2) if _ is not None else ():
            shared[p, *pair] = shared.get((p, *pair), 0) + 1
    want = {(p, a, b): (n, n / min(own[p, a], own[p, b])) for (p, a, b), n in shared.items()}
    found = lambda df: sorted(((x["project_id"], x["entity_a"], x["entity_b"]), (x["shared_chunks"], x["confidence"])) for x in df.collect())
    for block in (8, 64):
        rel = graph.build_relations(m, names=known, block=block, most=most)
        assert found(rel) == sorted(want.items()) and 1 in shared.values() and max(shared.values()) > 2
    assert found(graph.build_relations(m, names=known, at_least=2, most=most)) == sorted(x for x in want.items() if x[1][0] > 1)
    by_name = m.join(known, "entity_id").drop("entity_id")
    assert found(graph.build_relations(by_name, most=most)) == sorted(want.items())
    assert graph.build_relations(m.limit(0), names=known, most=most).count() == graph.build_relations(by_name.limit(0), at_least=2, most=most).count() == 0
    if most:  # of the names, only those of pairs that come again are shuffled once more
        plan = rel.select("*")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "LeftSemi" in plan and "LeftAnti" in plan


def test_registered_relations_and_hops_gather_no_pairs_by_name(spark, monkeypatch):
    from docstrata.plans import registry, search

    d, ask = "/root/testdata/sf0.001", registry.queries()
    for name in ("g5_relations", "g5_relations_all"):
        rel = ask[name](spark, d)
        plan = rel._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "LeftSemi" in plan and "LeftAnti" in plan
    strong, kept, store = rel.where("shared_chunks >= 2").count(), [], search.stored
    monkeypatch.setattr(search, "stored", lambda df: kept.append(store(df)) or kept[-1])
    for name in ("g2_k_hop", "g2_k_hop_all"):
        kept.clear()
        assert ask[name](spark, d).count() <= 5 * 30
        assert [x.count() for x in kept] == [strong]  # all that hops are taken over


def test_packed_equals_the_fold(spark):
    r = random.Random(5)
    cases = [[]] + [[" ".join("w" * r.randint(1, 12) for _ in range(r.choice([1, 3, 8, 30]))) for _ in range(r.randint(1, 15))] for _ in range(250)]
    cases += [["a b  c\u2003d" * 40] * 2, ["x" * 900], ["\u00e4" * 70, "y" * 900, "z z"], ["w"] * 300]
    parts = spark.createDataFrame([(i, c) for i, c in enumerate(cases)] + [(-1, None)], "id int, parts array<string>")
    for size, overlap in ((5, 0), (16, 1), (16, 4), (40, 12), (40, 39)):
        got = {x["id"]: x["p"] for x in parts.select("id", chunking.packed(F.col("parts"), size, overlap).alias("p")).collect()}
        assert got.pop(-1) is None
        for i, c in enumerate(cases):
            assert got[i] == chunking.pack_sentences(c, size, overlap), (size, overlap, c)


def test_chunks_need_no_python_worker(spark):
    pages = spark.createDataFrame([("d", 1, "One. Two three! " * 180), ("d", 2, None), ("e", 1, "word " * 600)], "doc_id string, page_number int, text string")
    out = chunking.chunk_pages(pages, size=64)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = sorted(out.collect())
    assert got == sorted(chunking.chunk_pages(pages, size=64, whole=True).collect())  # the same by the fold for texts of any length
    assert {x["doc_id"] for x in got} == {"d", "e"}
    long = "word " * 60_000
    whole = chunking.chunk_pages(spark.createDataFrame([("f", 1, long)], pages.schema), size=64, whole=True).orderBy("chunk_index")
    assert [x["text"] for x in whole.collect()] == chunking.pack_sentences([long.strip()], 64, 6)
