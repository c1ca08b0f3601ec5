"""Literal cases and invariants of the retrieval operators."""

import pytest
from pyspark.sql import functions as F

from docstrata.functions import text as T
from docstrata.functions.stem import porter_stem
from docstrata.operators import chunking, drafts, graph, lexical, numbering, quality, ranking, sessions, vectors
from docstrata.sources import tables


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


CHUNKS = [
    ("c1", "doc1", "The quick brown fox jumps over the lazy dog"),
    ("c2", "doc1", "Machine learning is a field of artificial intelligence"),
    ("c3", "doc1", "Python is a popular programming language for machine learning"),
    ("c4", "doc1", "Neural networks learn from data"),
]


def search(spark, text, k=10):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, doc_id string, text string")
    queries = spark.createDataFrame([(1, text)], "query_id int, query string")
    return [r["chunk_id"] for r in lexical.search(lexical.build(chunks), queries, k).orderBy("rank").collect()]


def test_lexical_search(spark):
    assert search(spark, "python") == ["c3"]
    assert search(spark, "machine learning python") == ["c3"]
    assert search(spark, " ?! ") == []
    assert set(search(spark, "fox or machine or networks or nothing else")) == {"c1", "c2", "c3", "c4"}


def test_query_words(spark):
    words = lambda q: one(spark, T.query_words(F.lit(q)))
    assert {"learn", "python"} <= set(words("what is the best way to learn python")) and "the" not in words("what is the best way")
    assert words("the a an") == ["the", "a", "an"]
    assert one(spark, T.fts_expression(T.query_words(F.lit("machine learning python")))) == '"machine" AND "learning" AND "python"'


def test_inline_filters(spark):
    q = F.lit("find docs about AI in file:report.pdf")
    assert one(spark, T.filename_filter(q)) == "report.pdf" and one(spark, T.without_filters(q)) == "find docs about AI in"


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("hopping", "hop"), ("filing", "file"), ("relational", "relat"), ("vietnamization", "vietnam"), ("adjustable", "adjust"), ("controll", "control"), ("happy", "happi"), ("sky", "sky")])
def test_porter(word, stem):
    assert porter_stem(word) == stem


def lists(spark, *named):
    rows = [(1, s, i + 1, c) for s, ids in named for i, c in enumerate(ids)]
    return spark.createDataFrame(rows, "query_id int, source string, rank int, chunk_id string")


def test_fusion(spark):
    got = [r["chunk_id"] for r in ranking.fuse(lists(spark, ("a", ["c1", "c2", "c3"]), ("b", ["c2", "c1", "c4"]))).orderBy("rank").collect()]
    assert set(got[:2]) == {"c1", "c2"} and got[2:] == ["c3", "c4"]
    assert [r["chunk_id"] for r in ranking.fuse(lists(spark, ("a", ["x", "y"]))).orderBy("rank").collect()] == ["x", "y"]
    twice = ranking.fuse(lists(spark, ("a", ["c1", "c1", "c2"]))).collect()
    assert len(twice) == 2


def test_diversify(spark):
    def run(vs, k, q=None):
        rows = [(1, i + 1, f"c{i}", 1.0 - i / 100, v, q) for i, v in enumerate(vs)]
        df = spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, score double, embedding array<double>, query_embedding array<double>")
        return [r["chunk_id"] for r in ranking.diversify(df, k).orderBy("rank").collect()]

    eye = [[1.0 if i == j else 0.0 for j in range(10)] for i in range(10)]
    assert len(run(eye, 5, eye[0])) == 5 and run(eye, 5, eye[3])[0] == "c3"
    assert len(set(run([eye[0]] * 10, 5, eye[0]))) == 5
    assert run([None] * 5, 3) == ["c0", "c1", "c2"]
    assert run([eye[0], None, eye[1]], 3, eye[0]) == ["c0", "c2", "c1"]


def test_threshold_keeps_one(spark):
    rows = spark.createDataFrame([(1, 1, "a", 0.2), (1, 2, "b", 0.1), (2, 1, "c", 0.9), (2, 2, "d", 0.1)], "query_id int, rank int, chunk_id string, score double")
    assert {r["chunk_id"] for r in ranking.threshold(rows, 0.5).collect()} == {"a", "c"} and ranking.threshold(rows, 0).count() == 4


def pages_of(spark, *texts):
    return spark.createDataFrame([("d", i + 1, t, []) for i, t in enumerate(texts)], "doc_id string, page_number int, text string, tables array<string>")


def test_paging(spark):
    docs = spark.createDataFrame([("a", "x" * 7500), ("b", "  \n"), ("c", None)], "doc_id string, text string")
    got = chunking.virtual_pages(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("t")).collect()
    by = {r["doc_id"]: r for r in got}
    assert by["a"]["n"] == 3 and by["b"]["t"] == "(empty file)" and by["c"]["t"] == "(empty file)"


def test_chunking(spark):
    text = " ".join(f"This is sentence number {i} of the test text." for i in range(200))
    got = chunking.chunk_pages(pages_of(spark, text), size=128).orderBy("chunk_index").collect()
    assert len(got) > 1 and len({r["chunk_id"] for r in got}) == len(got) and all(r["token_count"] <= 128 + 8 for r in got)
    assert all(any(f"number {i} of" in r["text"] for r in got) for i in range(200))
    assert got[1]["text"].split(". ")[0] in got[0]["text"]
    three = chunking.chunk_pages(pages_of(spark, text, text, text), size=64).collect()
    assert sorted(r["chunk_index"] for r in three) == list(range(len(three)))
    long = chunking.chunk_pages(pages_of(spark, "word " * 3000), size=64).collect()
    assert len(long) > 10 and max(r["token_count"] for r in long) <= 90


def test_tables_stay_whole(spark):
    page = spark.createDataFrame([("d", 1, "Some text here.", ["a | b\n1 | 2"])], "doc_id string, page_number int, text string, tables array<string>")
    got = {r["chunk_id"]: r for r in chunking.chunk_pages(page).collect()}
    assert got["d__p1__table0"]["text"] == "a | b\n1 | 2" and got["d__p1__table0"]["is_table"] and not got["d__p1__c1"]["is_table"]


def test_parents(spark):
    rows = [("d", f"c{i}", 1, i, f"t{i}", False) for i in range(6)] + [("e", "x", 1, 0, "only", False)]
    named, parents = chunking.parent_groups(spark.createDataFrame(rows, "doc_id string, chunk_id string, page_number int, chunk_index int, text string, is_table boolean"))
    assert {r["parent_text"] for r in parents.collect()} == {"t0 t1 t2 t3", "t4 t5"}
    hits = spark.createDataFrame([(1, 1, "c1", 0.9), (1, 2, "c0", 0.8), (1, 3, "x", 0.7)], "query_id int, rank int, chunk_id string, score double")
    got = chunking.expand_to_parents(hits, named, parents).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [("d__p1__parent0", 0.9), ("x", 0.7)]


def test_entities_and_hops(spark):
    m = spark.createDataFrame([(1, "Apple", "org", "AAPL", "k1", 1), (1, "Apple", "org", "APL", "k2", 1), (1, "Pear", "org", "P", "k2", 2), (1, "Plum", "org", "PL", "k3", 1), (1, "Pear", "org", "P", "k3", 2)], "project_id int, entity_name string, entity_type string, synonym string, chunk_id string, seq int")
    e = graph.aggregate_entities(m)
    names = spark.createDataFrame([(1, 1, "apple"), (2, 1, "aapl"), (3, 1, "none")], "query_id int, project_id int, name string")
    hit = graph.match_entities(names, e)
    assert sorted((r["query_id"], r["entity_name"], r["occurrence_count"]) for r in hit.collect()) == [(1, "Apple", 2), (2, "Apple", 2)]
    assert [r["chunk_id"] for r in graph.entity_chunks(hit, e).where("query_id = 1").orderBy("rank").collect()] == ["k1", "k2"]
    seeds = spark.createDataFrame([(1, 1, "Apple")], "query_id int, project_id int, entity_name string")
    hops = {(r["entity_name"], r["depth"]) for r in graph.expand_hops(seeds, graph.build_relations(m)).collect()}
    assert hops == {("Pear", 1), ("Plum", 2), ("Apple", 2)}


@pytest.mark.parametrize("block", [4, 64])
def test_relations_of_all_chunks(spark, block):
    from itertools import combinations

    chunks = {"long": [f"e{i:02}" for i in range(40)], "short": ["e01", "e03", "x"], "one": ["x"], "mid": [f"e{i:02}" for i in range(5, 18)]}
    m = spark.createDataFrame([(1, e, c) for c, v in chunks.items() for e in v + v[:1]], "project_id int, entity_name string, chunk_id string")
    shared = {}
    for v in chunks.values():
        for pair in combinations(sorted(v), 2):
            shared[pair] = shared.get(pair, 0) + 1
    n = {e: sum(e in v for v in chunks.values()) for v in chunks.values() for e in v}
    got = graph.build_relations(m, block=block).collect()
    assert len(got) == len(shared) and {(r["entity_a"], r["entity_b"]): r["shared_chunks"] for r in got} == shared
    assert all(abs(r["confidence"] - r["shared_chunks"] / min(n[r["entity_a"]], n[r["entity_b"]])) < 1e-12 for r in got)


def test_plans_have_no_cartesian_product(spark):
    m = spark.createDataFrame([(1, "Apple", "org", "AAPL", "k1", 1)], "project_id int, entity_name string, entity_type string, synonym string, chunk_id string, seq int")
    names = spark.createDataFrame([(1, 1, "apple")], "query_id int, project_id int, name string")
    for df in (graph.match_entities(names, graph.aggregate_entities(m)), graph.expand_hops(names.withColumnRenamed("name", "entity_name"), graph.build_relations(m))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    scored = spark.range(9).select((F.col("id") % 2).alias("query_id"), F.col("id").alias("chunk_id"), F.rand(1).alias("score"))
    assert "WindowGroupLimit" in ranking.cut(ranking.ranked(scored, "query_id"), 2)._jdf.queryExecution().executedPlan().toString()


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [0.0, 0.0], 1), ("c", [0.6, 0.8], 2)], "chunk_id string, embedding array<double>, project_id int")
    q = spark.createDataFrame([(1, [1.0, 0.0], 2), (2, [0.0, 0.0], 1)], "query_id int, query_embedding array<double>, query_project int")
    assert [(r["query_id"], r["chunk_id"], r["score"]) for r in vectors.exact_top_k(v, q, k=5).orderBy("rank").collect()] == [(1, "a", 1.0), (1, "c", 0.6)]
    assert [r["chunk_id"] for r in vectors.exact_top_k(v, q, same_project=True).collect()] == ["c"]
    assert vectors.exact_top_k(v.limit(0), q).count() == 0 and vectors.exact_top_k(v, q.limit(0)).count() == 0


def test_searches_ask_each_20th(spark, monkeypatch):
    import numpy as np

    from docstrata.plans import registry
    from docstrata.sources import views as V

    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", 7)
    sf = "/root/testdata/sf0.01"
    rows = V.vectors(spark, sf).select("chunk_no", "chunk_id", "project_id", "embedding").collect()
    m = np.array([r["embedding"] for r in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    asked = [i for i, r in enumerate(rows) if r["chunk_no"] % 20 == 0]
    for name, k, scoped in (("v2_exact_top50_all", 50, False), ("v2_top10_in_project_all", 10, True)):
        want = set()
        for i in asked:
            near = [(-round(float(m[i] @ m[j]), 8), r["chunk_id"]) for j, r in enumerate(rows) if not scoped or r["project_id"] == rows[i]["project_id"]]
            want |= {(rows[i]["chunk_no"], c) for _, c in sorted(near)[:k]}
        assert {(r["query_id"], r["chunk_id"]) for r in registry.queries()[name](spark, sf).collect()} == want and len(asked) == 25
    assert registry.queries()["r21_query_cache_similar_all"](spark, sf).count() == 25
    assert {r["query_id"] for r in registry.queries()["v3_approximate_top20_all"](spark, sf).collect()} == {rows[i]["chunk_no"] for i in asked}


def test_leader_clusters(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [0.99, 0.14]), (1, 3, [0.0, 1.0]), (1, 4, [0.1, 0.99])]
    got = {r["id"]: r["leader_id"] for r in quality.leader_clusters(spark.createDataFrame(rows, "project_id int, id int, embedding array<double>")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def test_near_pairs_of_all_ids(spark, tmp_path):
    import numpy as np

    from docstrata.plans import registry

    r = np.random.default_rng(5)
    m = np.repeat(r.normal(size=(30, 8)), 4, axis=0) + 0.3 * r.normal(size=(120, 8))
    m[7] = 0
    rows = [(999_950 + i, x, int(i % 8 == 5)) for i, x in enumerate(m.tolist())]
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    want = {(rows[i][0], rows[j][0]) for i in range(120) for j in range(i + 1, 120) if rows[i][2] == rows[j][2] and round(float(unit[i] @ unit[j]), 6) >= 0.8}
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    v9 = registry.queries()["v9_near_pairs"](spark, str(tmp_path)).collect()
    assert len(v9) == len(want) and {(x["a"], x["b"]) for x in v9} == want and any(a >= 1_000_000 for a, _ in want)
    v = spark.createDataFrame(rows, "id long, embedding array<double>, project_id int")
    blocks = vectors.near_pairs(v, 0.8, block_rows=10).collect()
    assert len(blocks) == len(want) and {(x["a"], x["b"]) for x in blocks} == want
    clusters = registry.queries()["v9_leader_clusters"](spark, str(tmp_path)).collect()
    assert max(x["id"] for x in clusters) == rows[-1][0]


def test_context_and_compaction(spark):
    m = spark.createDataFrame([(1, i, "user", "x" * 5000, 1250) for i in range(20)] + [(2, i, "user", "hi", 1) for i in range(2)], "session_id int, pos int, role string, content string, token_count int")
    state = {r["session_id"]: r for r in sessions.context_status(m, sessions.context_size(F.lit("gpt-3.5-turbo"))).collect()}
    assert state[1]["should_warn"] and state[1]["should_block"]
    after = sessions.compacted(m, spark.createDataFrame([(1, "s"), (2, "s")], "session_id int, summary string"))
    n = {r["session_id"]: r["count"] for r in after.groupBy("session_id").count().collect()}
    assert n == {1: 9, 2: 2}


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tables.upsert(old, new, "k")) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(tables.insert_or_ignore(old, new, "k")) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(tables.delete(old, new, "k")) == [(1, "a")]
    assert rows(tables.update_fields(old, new, "k", "v")) == [(1, "a"), (2, "c"), (3, "d")]
    files = tables.content_hash(spark.createDataFrame([("d2", "x"), ("d1", "x"), ("d3", "y")], "doc_id string, content string"))
    assert {r["doc_id"]: r["duplicate_of"] for r in tables.deduplicate(files).collect()} == {"d2": "d1", "d1": None, "d3": None}


def test_jsonl(spark, tmp_path):
    from pyspark.sql import types as t

    (tmp_path / "s1.jsonl").write_text('{"role": "user", "content": "a"}\n\n{broken\n{"role": "assistant", "content": "b"}\n')
    schema = t.StructType([t.StructField("role", t.StringType()), t.StructField("content", t.StringType())])
    got = tables.read_messages(spark, str(tmp_path), schema).collect()
    assert sorted(r["content"] for r in got) == ["a", "b"] and {r["session_id"] for r in got} == {"s1"}


def test_jsonl_of_all_sessions(spark):
    from docstrata.plans import registry
    from docstrata.sources import views as V

    sf = "/root/testdata/sf0.001"
    want = {(r["session_id"], r["role"]): r["count"] for r in V.messages(spark, sf).groupBy("session_id", "role").count().collect()}
    got = registry.queries()["s7_jsonl_messages_all"](spark, sf).collect()
    assert len(got) == len(want) and {(r["session_id"], r["role"]): r["n"] for r in got} == want and len({s for s, _ in want}) >= 20


def test_sections(spark):
    md = spark.createDataFrame([(1, "lead\n# Project Overview\nIt is a text that is long. Another one follows here. x\n## Deliverables\nold\n## Deliverables\nThe vendor shall act.")], "doc_id int, text string")
    got = {r["section_id"]: r["text"] for r in drafts.sections(md).collect()}
    assert set(got) == {"overview", "deliverables"} and "old" not in got["deliverables"]
    sig = {r["section_id"]: r for r in drafts.signatures(md).collect()}
    assert len(sig) == 7 and sig["deliverables"]["obligations"] == "shall" and sig["deliverables"]["parties"] == "vendor" and sig["timeline"]["summary"] == ""


def test_row_numbers(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("k"))
    got = numbering.row_numbers(df, "k", "n", strip_rows=100).collect()
    assert sorted((r["k"], r["n"]) for r in got) == [(f"k{i:05d}", i + 1) for i in range(1000)]


def test_kept_index(spark, tmp_path):
    chunks = spark.createDataFrame([*CHUNKS, ("c5", "doc2", None), ("c6", "doc2", "")], "chunk_id string, doc_id string, text string")
    queries = spark.createDataFrame([(1, "python"), (2, "learning data"), (3, " ?! ")], "query_id int, query string")
    hits = lambda index: sorted(map(tuple, lexical.search(index, queries).collect()))
    folder = f"file://{tmp_path}/ix"
    lexical.build(chunks.where("chunk_id < 'c3'"), folder)
    lexical.append(folder, chunks.where("chunk_id >= 'c3'"), 2)
    whole = hits(lexical.read(spark, folder, "string"))
    assert whole == hits(lexical.build(chunks)) == sorted(map(tuple, lexical.search_texts(chunks, queries).collect())) != []
    assert whole == sorted(map(tuple, lexical.search_texts(chunks, queries, listed_terms=1).collect()))
    lexical.delete(folder, chunks.where("chunk_id in ('c3', 'c5')"), 2)
    left = chunks.where("chunk_id not in ('c3', 'c5')")
    assert hits(lexical.read(spark, folder, "string")) == hits(lexical.build(left)) and all(h[2] != "c3" for h in hits(lexical.read(spark, folder, "string")))
    lexical.append(folder, chunks.where("chunk_id in ('c3', 'c5')"), 3)
    assert hits(lexical.read(spark, folder, "string")) == whole


def test_postings_count_terms(spark):
    got = {(r["chunk_id"], r["term"]): (r["tf"], r["dl"]) for r in lexical.postings(spark.createDataFrame([(1, "b a B c a b"), (2, None), (3, "...")], "chunk_id int, text string")).collect()}
    assert got == {(1, "a"): (2, 6), (1, "b"): (3, 6), (1, "c"): (1, 6)}


def test_names_by_runs(spark):
    files = spark.createDataFrame([(1, "Report_2024.PDF"), (2, "old report.txt"), (3, "notes"), (4, "rep")], "doc_id int, filename string")
    asked = spark.createDataFrame([(1, "REPORT"), (2, "t"), (3, "2024.p"), (4, "none"), (5, ""), (6, "ot")], "query_id int, name string")
    got = {(r["query_id"], r["doc_id"]) for r in tables.named_like(asked, files, "doc_id").collect()}
    low = [(r["doc_id"], r["filename"].lower()) for r in files.collect()]
    assert got == {(q["query_id"], i) for q in asked.collect() for i, f in low if q["name"] and q["name"].lower() in f}


def grades_of(spark, rows):
    from datetime import datetime, timedelta

    at = [(i, p, datetime(2024, 1, 1) + timedelta(hours=h), 0.4, "", False) for i, p, h in rows]
    return spark.createDataFrame(at, "id int, project_id int, created_at timestamp, retrieval_grade double, grade_label string, watcher_processed boolean")


def test_late_rows_of_a_stream(spark, tmp_path):
    """A stream drops what comes behind its watermark; the batch rule names just those rows."""
    from docstrata.streaming import flows

    first, second, late, final = [(1, 1, 0), (2, 1, 30)], [(3, 1, 29.5)], [(4, 1, 1)], [(5, 1, 90)]
    rows = first + second + late + final
    for n, part in enumerate((first, second, late, final)):
        grades_of(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/p{n}")
    stream = spark.readStream.schema(grades_of(spark, first).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = flows.drained(spark, flows.daily_metrics(stream), f"file://{tmp_path}/out").collect()
    counted = {r["window"]["start"].day: r["query_count"] for r in got}
    assert counted == {1: 1, 2: 2}
    dropped = {r["id"] for r in flows.late_rows(grades_of(spark, rows), "id", "created_at", strip_rows=2).collect()}
    assert dropped == {4}


def test_ingest_batches_can_run_again(spark, tmp_path):
    from docstrata.streaming import flows

    folder = f"file://{tmp_path}/in"
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id string, text string")
    one, two = docs(("a", "One. Two."), ("b", "One. Two."), ("c", "Other text.")), docs(("c", "New text of c."), ("d", "One. Two."), ("e", None))
    for batch, number in ((one, 0), (one, 0), (two, 1), (two, 1)):
        flows.ingest_batch(batch, number, folder, size=64)
    assert sorted((r["doc_id"], r["text"]) for r in flows.current(spark, folder).collect()) == [("a", "One. Two."), ("c", "New text of c."), ("e", "(empty file)")]


def test_pack_sentences_rules():
    """Against a reading of the rules one sentence at a time."""
    import random

    r = random.Random(3)
    for _ in range(400):
        parts = [" ".join("w" * r.randint(1, 12) for _ in range(r.choice([1, 3, 8, 30]))) for _ in range(r.randint(0, 15))]
        size, overlap = r.choice([5, 16, 40]), r.choice([0, 1, 4, 12])
        got = chunking.pack_sentences(parts, size, overlap)
        cost = chunking.token_cost
        assert " ".join(w for p in parts for w in p.split()) == "" or got
        if all(cost(p) <= size for p in parts):
            at = 0
            for chunk, after in zip(got, [*got[1:], None]):
                n = next(n for n in range(1, len(parts) - at + 1) if " ".join(parts[at : at + n]) == chunk)
                end = at + n
                if after is None:
                    assert end == len(parts)
                    break
                assert sum(map(cost, parts[at : end + 1])) > size  # the next sentence did not fit
                back = 0
                while back < n and sum(map(cost, parts[end - back - 1 : end])) <= overlap:
                    back += 1
                at = end - back
        else:
            assert all(w in " ".join(got).split() for p in parts for w in p.split())


@pytest.mark.parametrize("gone", [("docstrata/llm",), ("docstrata/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",), ()])
def test_entry_without_llm(tmp_path, gone):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "docstrata"):
        if (top / name).exists():
            shutil.copytree(top / name, tmp_path / name) if (top / name).is_dir() else shutil.copy(top / name, tmp_path)
    for name in gone:
        if (tmp_path / name).exists():
            shutil.rmtree(tmp_path / name) if (tmp_path / name).is_dir() else (tmp_path / name).unlink()
    both = all((tmp_path / name).exists() for name in ("docstrata/llm", "corpus_pipeline.py"))
    code = f"import __spark_entry__ as e; q = e.queries(); assert len(q) > 170; assert set(e.oracle_sql()) <= set(q); assert ('pipeline' in q) == {both}"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)})
