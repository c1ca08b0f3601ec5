"""What only larger tables, or whole ones, bring out."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

import __spark_entry__
from docstrata.functions.stem import porter_stem
from docstrata.llm import secrets
from docstrata.operators import block_max, lexical, vector_index, vectors


def by_sql(name, folder, *tables):
    db = duckdb.connect()
    for t in tables:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return db.sql(__spark_entry__.oracle_sql()[name]).fetchall()


def test_insert_or_ignore_where_new_keys_are_there_already(spark, tmp_path):
    rows = spark.range(1, 12_001).selectExpr("cast(id as int) as s_suppkey", "cast(id as double) as s_acctbal")
    rows.write.parquet(f"{tmp_path}/supplier.parquet")
    found = sorted(tuple(r) for r in __spark_entry__.queries()["s12_insert_or_ignore"](spark, str(tmp_path)).collect())
    assert found == sorted(by_sql("s12_insert_or_ignore", tmp_path, "supplier")) and len(found) == 12_000 + 5_000


def test_ordinary_writing_is_all_text_in_all_alphabets_and_lengths():
    """Each full window of each document counts, in each alphabet and length, in the cell that a candidate of that kind would have."""
    r = random.Random(5)
    texts = ["".join(r.choice("abcdeABCDE 0123456789-_é.") for _ in range(n)) for n in (0, 15, 700, 4_000)] + ["tail of writing " * 5_000]
    expected = {}
    for text in texts:
        raw = text.encode()
        for i, a in enumerate(secrets._ALPHABETS):
            for at in range(0, len(raw), secrets._PIECE):
                code = a.code[np.frombuffer(raw[at : at + secrets._PIECE], np.uint8)]
                code = code[code < 255].astype(np.int64)
                for length, n in enumerate(secrets._LENGTHS):
                    windows = code[: len(code) // n * n].reshape(-1, n)
                    for c in secrets._cells(a.statistics(windows)) if len(windows) else ():
                        place = (length * len(secrets._ENCODINGS) + i) * secrets._CELLS + int(c)
                        expected[place] = expected.get(place, 0) + 1
    assert secrets.ordinary([(t, []) for t in texts]) == expected
    cut = secrets.ordinary([("a b c d " * 40 + "SECRETTOKEN" + " e f" * 40, [("random", 320, 331, False, 0, 0)])])
    assert cut == secrets.ordinary([("a b c d " * 40 + "  e f" + " e f" * 39, [])])


def test_bm25_passes_on_k_hits_of_a_query_from_a_task(spark, monkeypatch):
    """Chunks that share a term with a query never leave their task but for the k best; rounds, small blocks and repeated ids change nothing."""
    r = random.Random(8)
    text = lambda: " ".join(f"w{int(r.random() ** 2 * 40)}" for _ in range(30))
    chunks = spark.createDataFrame([(f"c{i:04d}", text()) for i in range(600)], "chunk_id string, text string").repartition(3).cache()
    queries = spark.createDataFrame([(i, text()[:40] if i % 4 else f"w{i} w{i + 1}") for i in range(20)], "query_id int, query string")
    passed, plain = [], lexical._scorer

    def scorer(*args):
        run = plain(*args)
        seen = spark.sparkContext.accumulator(0)
        passed.append(seen)

        def counted(batches):
            for b in run(batches):
                seen.add(b.num_rows)
                yield b

        return counted

    monkeypatch.setattr(lexical, "_scorer", scorer)
    whole = sorted(map(tuple, lexical.search_texts(chunks, queries, 5).collect()))
    assert len(whole) == 100 and 0 < sum(x.value for x in passed) <= 20 * 5 * 16  # 20 queries, 5 hits, at most 16 tasks
    monkeypatch.setattr(lexical, "QUERY_TERMS", 20)
    monkeypatch.setattr(lexical, "SUMS_AT_ONCE", 50)
    assert sorted(map(tuple, lexical.search_texts(chunks, queries, 5).collect())) == whole
    assert sorted(map(tuple, lexical.search_texts(chunks, queries, 5, listed_terms=1).collect())) == whole
    twice = chunks.unionByName(chunks.where("chunk_id = 'c0001'")).unionByName(spark.createDataFrame([(None, "w1 w2"), (None, "w1 w2")], chunks.schema))
    got = lexical.search_texts(twice, queries, 600).groupBy("query_id", "chunk_id").count()
    assert got.where("count > 1").count() == 0 and got.where("chunk_id is null").count() > 0


def test_near_pairs_are_sent_on_in_small_parts(spark, monkeypatch):
    """A vector that is a guest of many regions, and a block with a pair at every place, go on in parts of bounded size."""
    r = np.random.default_rng(4)
    rows = [(1, i, [float(x) for x in r.normal(size=8)]) for i in range(300)] + [(1, 300 + i, [1.0] * 8) for i in range(300)]
    v = spark.createDataFrame(rows, "project_id int, id int, embedding array<double>")
    whole = sorted(map(tuple, vectors.near_pairs(v, 0.3, block_rows=64).collect()))
    monkeypatch.setattr(vectors, "ROUTED_AT_ONCE", 7)
    assert sorted(map(tuple, vectors.near_pairs(v, 0.3, block_rows=64).collect())) == whole
    unit = np.array([x[2] for x in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(np.round(unit @ unit.T, 6) >= 0.3, 1))
    assert [(x[1], x[2]) for x in whole] == list(zip(a.tolist(), b.tolist()))


def test_stemmed_vocabulary_reads_the_texts_once(spark, tmp_path):
    """Terms are counted before they are shuffled, and each is stemmed where it was counted: no second pass, no join."""
    r = random.Random(9)
    texts = [" ".join(r.choice(("running", "Runs", "ran", "flies", "fly", "é9", "the")) for _ in range(r.randint(1, 40))) for _ in range(90)] + [None, "", "..."]
    spark.createDataFrame([(i, t, "en", "web", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = __spark_entry__.queries()["r1_stemmed_vocabulary"](spark, str(tmp_path))
    terms = Counter(t for text in texts for t in re.findall("[0-9a-zé]+", (text or "").lower()))
    terms.update({"empty": 2, "file": 2})  # a blank text is one page that says so
    expected = {}
    for term, n in terms.items():
        tf, own = expected.get(porter_stem(term), (0, 0))
        expected[porter_stem(term)] = tf + n, own + 1
    assert {x["stem"]: (x["tf"], x["terms"]) for x in found.collect()} == expected
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan


def test_block_max_passes_on_k_hits_of_a_query_from_a_task(spark, monkeypatch):
    """Postings meet by range, once for all queries; a task passes on no more than k hits of each. Small parts and rounds change nothing."""
    r = random.Random(10)
    text = lambda: " ".join(f"w{int(r.random() ** 2 * 60)}" for _ in range(40))
    chunks = spark.createDataFrame([(f"c{i:04d}", text() if i % 50 else None) for i in range(900)], "chunk_id string, text string").repartition(3).cache()
    queries = spark.createDataFrame([(i, text()[:50] if i % 4 else f"w{i} w{i + 1}") for i in range(20)], "query_id int, query string")
    gone = chunks.where("chunk_id like '%3'")
    now = sorted(map(tuple, lexical.search_texts(chunks.join(gone, "chunk_id", "left_anti"), queries, 5).collect()))
    passed, plain = [], block_max._scorer

    def scorer(*args):
        numbers, names, run = plain(*args)
        seen = spark.sparkContext.accumulator(0)
        passed.append(seen)

        def counted(batches):
            for b in run(batches):
                seen.add(b.num_rows)
                yield b

        return numbers, names, counted

    monkeypatch.setattr(block_max, "_scorer", scorer)
    for postings, rows, terms, sums in ((1 << 18, 2_048, 1 << 17, 1 << 21), (50, 7, 20, 100)):
        monkeypatch.setattr(block_max, "_POSTINGS_AT_ONCE", postings)
        monkeypatch.setattr(block_max, "_ROWS_AT_ONCE", rows)
        monkeypatch.setattr(lexical, "QUERY_TERMS", terms)
        monkeypatch.setattr(lexical, "SUMS_AT_ONCE", sums)
        folder = block_max.build(chunks, range_chunks=16)
        block_max.delete(spark, folder, gone, 1)
        assert sorted(map(tuple, block_max.search(spark, folder, queries, 5).collect())) == now
    assert len(now) == 100 and 0 < sum(x.value for x in passed[:2]) <= 2 * 20 * 5 * 4  # two searches of ranges, 20 queries, 5 hits, 4 tasks


def test_block_max_counts_terms():
    lists = [["b", "a", "b", "a", "c"], [], ["é", "z", "é"], ["z"], ["z", "é"]]
    assert block_max._counts(pa.array(lists, pa.list_(pa.string()))).field(0).to_pylist() == ["a", "", "é", "z", "z"]
    found = block_max._counts(pa.array([[], *lists], pa.list_(pa.string())).slice(1))
    assert [dict(zip(x["terms"], x["tfs"])) for x in found.to_pylist()] == [dict(Counter(x)) for x in lists]
    assert block_max._counts(pa.array([[], []], pa.list_(pa.string()))).field(1).to_pylist() == [[], []]


def test_vector_index_passes_on_a_shortlist_of_a_query_from_a_task(spark, monkeypatch):
    """However many cells a query looks into, a task passes on one shortlist of it; parts, groups and rounds change nothing."""
    r = np.random.default_rng(11)
    rows = [(f"v{i:04d}", [float(x) for x in r.normal(size=8)]) for i in range(1_200)]
    v = spark.createDataFrame(rows, "chunk_id string, embedding array<double>").cache()
    asked = v.limit(60).selectExpr("cast(substr(chunk_id, 2) as int) as query_id", "embedding as query_embedding").cache()
    folder = vector_index.build(v, cells=20, recall=0.999)
    passed, plain = [], vector_index._rater

    def rater(*args):
        run, seen = plain(*args), spark.sparkContext.accumulator(0)
        passed.append(seen)

        def counted(batches):
            for b in run(batches):
                seen.add(b.num_rows)
                yield b

        return counted

    monkeypatch.setattr(vector_index, "_rater", rater)
    whole = sorted(map(tuple, vector_index.search(folder, asked, k=3, shortlist=4, probes=20).collect()))
    assert len(whole) == 180 and passed[0].value == 60 * 12  # one part of the codes: a shortlist of 12 of each query, from 20 cells
    for name, small in (("PART_ROWS", 300), ("_QUERIES", 7), ("_CODES", 11), ("_GUESSES", 400)):
        monkeypatch.setattr(vector_index, name, small)
    assert sorted(map(tuple, vector_index.search(folder, asked, k=3, shortlist=4, probes=20).collect())) == whole
