"""Brute force, exact round trips and edge cases of the ten operators, on small tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstrata.llm import bpe, exact_search, html_text, media, ngram_join, packing, pii, secrets, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def frame(spark, texts, first=0):
    rows = [(i + first, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near_groups(texts):
    up = list(range(len(texts)))
    sets = [shingles(t) for t in texts]

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def varied(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = r.choices(vocabulary, k=60)
    texts = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.5 and texts:
            w = r.choice(texts).split()
            for _ in range(r.randint(0, 4)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w))
        elif kind < 0.7:
            texts.append(" ".join(passage + r.choices(vocabulary, k=r.randint(1, 80))))
        else:
            texts.append(" ".join(r.choices(vocabulary, k=r.choice([0, 1, 3, 4, 5, 6, 9, 30, 200]))))
    return texts


@pytest.mark.parametrize("light,block_rows", [(32, 512), (2, 8)])
def test_ngram_join_is_brute_force(spark, light, block_rows):
    texts = [*varied(light), None, "", " \n", "One two\tTHREE", "one TWO three"]
    want, sizes = near_groups(texts)
    got = {r["doc_id"]: r for r in ngram_join.jaccard_components(frame(spark, texts), light=light, block_rows=block_rows).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes


def test_ngram_join_edges(spark):
    assert ngram_join.jaccard_components(frame(spark, [])).collect() == []
    twice = frame(spark, ["a b c d e f"]).unionByName(frame(spark, ["a b c d e f"])).unionByName(spark.createDataFrame([(None, "a b c d e f", None, None, None)], SCHEMA))
    rows = ngram_join.jaccard_components(twice.withColumn("node", F.lit(1)).withColumn("zone", F.lit("x"))).collect()
    assert len(rows) == 3 and {r["component_id"] for r in rows} == {0}
    kept = ngram_join.keep_first(frame(spark, ["a b c d e f", "a b c d e f", "x y", None]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_ngram_join_null_id_copy_first(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (7, text), (8, text), (3, text + " more"), (9, "something else altogether")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {None: 3, 7: 3, 8: 3, 3: 3, 9: 9}
    assert sorted(r["doc_id"] for r in ngram_join.keep_first(docs).where("doc_id is not null").collect()) == [3, 9]


def test_ngram_join_null_ids_link(spark):
    """Rows without an id link by near copies too, whichever rows come first."""
    words = [f"w{i}" for i in range(44)]
    near, far = " ".join(words[2:] + ["x"]), " ".join(f"v{i}" for i in range(50))
    rows = [(None, near), (5, " ".join(words)), (None, far), (None, far + " y"), (8, None), (None, None), (None, near)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in order], SCHEMA)
        got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in ngram_join.jaccard_components(docs).collect())
        assert got == [(-1, 0, -1), (-1, 39, 5), (-1, 39, 5), (-1, 46, -1), (-1, 47, -1), (5, 40, 5), (8, 0, 8)]
        kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_first(docs).collect()]
        assert sorted(map(str, kept)) == sorted(map(str, [(5, " ".join(words)), (None, far), (None, far + " y"), (8, None), (None, None)]))


def test_long_words_and_segments():
    text = "Ab " * 60_000 + "x" * 200_000 + " Ab"
    hashes = ngram_join.word_hashes(text)
    assert len(hashes) == 60_002 and hashes[0] == hashes[-1] and len(set(hashes.tolist())) == 2
    assert ngram_join.word_hashes("A b").size == 1


def test_tree_links_prunes_nothing_that_links():
    r = np.random.default_rng(1)
    sets = []
    for _ in range(80):
        base = sets[r.integers(len(sets))] if sets and r.random() < 0.6 else np.unique(r.integers(0, 500, 60)).astype(np.uint64)
        drop = r.random(len(base)) < r.choice([0.02, 0.1])
        sets.append(np.unique(np.concatenate([base[~drop], r.integers(0, 500, drop.sum()).astype(np.uint64)])))
    want = {(i, j) for i in range(80) for j in range(80) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert set(ngram_join.tree_links(sets, sets, 80, 100)) == want


def test_shards_balance_and_number(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(None, None, None, None, None), (10**6, "", None, "x", 0)], SCHEMA))
    got = sharding.kd_shards(docs, shards=8).toPandas()
    assert len(got) == docs.count()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() - sums.min() <= 2 * got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    row = docs.where("doc_id = 3").first()
    one = got[got["doc_id"] == 3].iloc[0]
    assert one["size"] == len(row["text"].encode()) + 1 and one["text_crc32"] == zlib.crc32(row["text"].encode())
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).all()


def test_shards_edges(spark):
    assert sharding.kd_shards(frame(spark, []), shards=4).collect() == []
    same = sharding.kd_shards(frame(spark, ["hot"] * 3000 + ["other text"] * 10), shards=4).toPandas()
    assert same.groupby("shard")["size"].sum().max() < 1.3 * same["size"].sum() / 4
    by_size = sharding.kd_shards(frame(spark, ["word " * 50] * 64), target_bytes=5000).toPandas()
    assert by_size.groupby("shard")["size"].sum().max() <= 10_000


def test_shards_keep_equal_texts_together(spark):
    """A group of a quarter of a shard stays whole; the other units make up for it."""
    texts = [f"text number {i} of many " + "x" * (i % 40) for i in range(5900)]
    share = sum(len(t) + 1 for t in texts) / 4
    texts += ["the same text " * 10] * int(share / 4 / 141) + ["another one " * 9] * int(share / 3 / 109)
    got = sharding.kd_shards(frame(spark, texts).withColumn("shard", F.lit("x")).withColumn("key", F.lit(None)).withColumn("node", F.lit(1)).withColumn("bytes", F.lit(1)), shards=4).toPandas()
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).all()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 4 and sums.max() - sums.min() < 0.02 * sums.mean() and len(got) == len(texts)


def test_shards_dimensions_and_null_ids(spark):
    rows = [(None if i % 3 else i, "hot", None, f"a common and long prefix of names {i % 7}", 3) for i in range(4000)] + [(i, f"t{i}", "en", None, None) for i in range(400)]
    got = sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), shards=4, dimensions=("source", "missing", "lang")).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(got) == 4400 and sums.max() < 1.1 * sums.mean() and sums.min() > 0.9 * sums.mean()
    by_name = sharding.kd_shards(spark.createDataFrame([(i, f"text {i}", "en", f"a common and long prefix of names {i % 2}", 1) for i in range(200)], SCHEMA), shards=2, dimensions=("source",)).toPandas()
    assert (by_name.assign(name=by_name["doc_id"] % 2).groupby("shard")["name"].nunique() == 1).all()


def test_shards_by_brute_force(spark):
    """The cut of each node against a sort of its units: no cut nearer to half of the bytes by more than the tolerance."""
    r = random.Random(8)
    texts = ["w" * r.randint(1, 400) + str(i) for i in range(1500)]
    got = sharding.kd_shards(frame(spark, texts), shards=2, dimensions=("n_chars",)).toPandas()
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    total = sum(len(t) + 1 for t in texts)
    left, best = 0, total
    for i in order:
        left += len(texts[i]) + 1
        best = min(best, abs(total - 2 * left))
    sums = got.groupby("shard")["size"].sum()
    assert abs(sums[0] - sums[1]) <= best + 2 * max(401, total / 512)
    low = got[got["shard"] == 0]["size"].max()
    assert (got[got["shard"] == 1]["size"] >= low).all()


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_on_labels(docs, labels)
    scored = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(toxicity.held_out()).select("toxicity", "toxic").toPandas()
    pos, neg = (scored[scored["toxic"] == y]["toxicity"].to_numpy() for y in (1, 0))
    assert (pos[:, None] > neg[None]).mean() > 0.85
    assert ((scored["toxicity"] >= 0.5) == scored["toxic"]).mean() > 0.9


def test_toxicity_edges(spark):
    labelled = frame(spark, ["fine words here", "you moron", None, ""]).withColumn("toxic", F.when(F.col("doc_id") == 1, 1).otherwise(0))
    model = toxicity.fit(labelled)
    out = toxicity.score(frame(spark, [None, "", "x" * 300_000, "fine"]).withColumn("toxicity", F.lit("clash")), model).collect()
    assert all(0 <= r["toxicity"] <= 1 for r in out) and out[0]["toxicity"] == out[1]["toxicity"]
    assert toxicity.score(frame(spark, []), model).collect() == []


def test_toxicity_labels_edges(spark):
    none = spark.createDataFrame([], SCHEMA + ", toxic int")
    assert all(0 <= r["toxicity"] < 0.5 for r in toxicity.score(frame(spark, ["a", None]), toxicity.fit(none)).collect())
    only = frame(spark, [f"bad {i} moron" for i in range(9)]).withColumn("toxic", F.lit(1))
    assert all(r["toxicity"] > 0.5 for r in toxicity.score(frame(spark, ["a"]), toxicity.fit(only)).collect())
    twice = frame(spark, ["fine words"] * 40).unionByName(frame(spark, ["you moron"] * 40)).withColumn("toxic", F.when(F.col("text") == "you moron", 1).when(F.col("doc_id") == 3, None).otherwise(0))
    labels = twice.select("doc_id", "toxic").unionByName(twice.select("doc_id", "toxic")).withColumn("text", F.lit("clash"))
    model = toxicity.fit_on_labels(twice, labels)
    assert toxicity.score(twice, model).count() == 80 and toxicity.fit_on_labels(twice.limit(0), labels.limit(0)).weight[-1] == -30


def test_toxicity_savings_by_brute_force(spark):
    """Each window compressed by itself, with compressors made anew."""
    import zstandard as zstd

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_on_labels(docs, labels)
    texts = [r["text"] for r in docs.limit(12).collect()] + ["", None, "one", "Ünïcode wörds " * 7]
    got = model.savings(texts)
    how = zstd.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, strategy=zstd.STRATEGY_BTOPT, min_match=3, search_log=4, hash_log=15, chain_log=15, window_log=17, target_length=24)
    for text, hist in zip(texts, got):
        want, words = np.zeros(21, int), (text or "").lower().split()
        for i in range(0, max(1, len(words)), 4):
            window = toxicity._ANCHOR + b" " + " ".join(words[i : i + 4]).encode()
            a, b = (len(zstd.ZstdCompressor(compression_params=how, dict_data=zstd.ZstdCompressionDict(d + toxicity._ANCHOR, dict_type=zstd.DICT_TYPE_RAWCONTENT)).compress(window)) for d in (model.ordinary, model.toxic + model.ordinary))
            want[min(14, max(-6, a - b)) + 6] += 1
        assert abs(hist - want).sum() <= max(2, 0.02 * want.sum())


def test_packing_fits_and_covers(spark):
    docs = frame(spark, [None, "", "one", "é" * 36_000, *(f"{'x ' * (i * 7 % 900)}" for i in range(300)), *["same"] * 90])
    docs = docs.unionByName(spark.createDataFrame([(None, "no id", None, None, None)] * 3, SCHEMA)).withColumn("length", F.lit("clash")).withColumn("row", F.lit(0)).withColumn("bin_id", F.lit(None))
    got = packing.best_fit(docs, shard_rows=100).toPandas()
    for i, n in ((0, 1), (1, 1), (2, 4), (3, 72_001), (394, 5)):
        part = got[got["doc_id"] == i].sort_values("piece") if i < 394 else got[got["doc_id"] == 393]
        assert part["length"].sum() == n and list(part["start"]) == [32_768 * k for k in range(len(part))]
    assert got["doc_id"].isna().sum() == 3 and len(got) == docs.count() + 2
    for _, b in got.groupby("bin_id"):
        b = b.sort_values("offset")
        assert b["length"].sum() <= b["capacity"].iloc[0] and list(b["offset"]) == [0, *b["length"].cumsum()[:-1]]
        assert b["capacity"].iloc[0] == min(c for c in packing.CAPACITIES if c >= b["length"].sum())
    assert packing.best_fit(frame(spark, [])).collect() == []


def test_packed_sequences_give_back_the_ids(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [None, "", "twice", "twice", "long " * 3000]
    coded = bpe.encode(frame(spark, texts)).withColumn("part", F.lit("clash"))
    rows = packing.sequences(coded, separator=50256, capacities=(64, 256, 1024), shard_rows=40).collect()
    want = {r["doc_id"]: [*r["ids"], 50256] for r in coded.collect()}
    pieces = {}
    for r in rows:
        assert len(r["ids"]) == r["capacity"] and r["capacity"] in (64, 256, 1024)
        ends = [*r["starts"][1:], None]
        for d, a, b in zip(r["doc_ids"], r["starts"], ends):
            pieces.setdefault(d, []).append(r["ids"][a:b])
    for d, ids in want.items():
        cut = [ids[i : i + 1024] for i in range(0, len(ids), 1024)]
        for got in sorted(pieces[d], key=len):
            match = next(c for c in cut if got[: len(c)] == c and set(got[len(c) :]) <= {50256})
            cut.remove(match)
        assert not cut
    used = sum(map(len, want.values()))
    assert used / sum(r["capacity"] for r in rows) > 0.9
    assert packing.sequences(coded.limit(0), separator=0).collect() == []


def naive_pack(lengths, sizes):
    """Best fit by looking at every open bin and every size, with the same costs."""
    bins, left = [], sorted(lengths, reverse=True)
    while left:
        x = left.pop(0)
        fits = [b for b in bins if b[0] >= x]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:

            def use(c):
                room, used = c - x, 0
                for y in left:
                    if y <= room:
                        room, used = room - y, used + y
                return used

            c = min((c for c in sizes if c >= x), key=lambda c: (packing.cost(c) / (x + use(c)), c))
            b = [c, 0]
            bins.append(b)
        b[0] -= x
        b[1] += x
    return sorted(min(c for c in sizes if c >= b[1]) for b in bins)


def test_packing_is_best_fit():
    r = random.Random(4)
    for _ in range(20):
        lengths = [r.randint(1, 64) for _ in range(r.randint(1, 60))]
        place, caps = packing.pack(lengths, (16, 32, 64))
        assert sorted(caps) == naive_pack(lengths, (16, 32, 64))
        used = [0] * len(caps)
        for (b, _), x in zip(place, lengths):
            used[b] += x
        assert all(u <= c for u, c in zip(used, caps))


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_pii(t):
    o = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    o += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    o += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    o += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(((k, m.start(), m.end()) for k, m in o), key=lambda x: (x[1], pii.BASE_KINDS.index(x[0])))


def base_secrets(t):
    o = [("assign", m) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I) if len(m[2]) >= 6]
    o += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    o += [("hex", m) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(((k, m.start(), m.end()) for k, m in o), key=lambda x: (x[1], secrets.KINDS.index(x[0])))


PIECES = ["a", "b.c", "@", "x_y", ".", "1", "22", "256", "4111111111111111", "+", "+1 ", "(555) ", "-", " ", "é", "😀", "AKIA", "ABCDEFGH1234", "deadbeef", "0123456789ab", "password", "Token", " = ", '"', ":", "192.168.1.1", "api_key"]


@pytest.mark.parametrize("module,base,kinds", [(pii, base_pii, pii.BASE_KINDS), (secrets, base_secrets, secrets.KINDS)])
def test_base_spans(spark, module, base, kinds):
    r = random.Random(7)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 24))) for _ in range(600)]
    texts += [None, "", "1" * 40_000, "a." * 9000 + "@" + "b." * 9000, "1 " * 9000, "+1" + "(" * 9000, "a" * 60_000]
    got = {x["doc_id"]: x for x in module.digest(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = base(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), texts[i]
        assert all(got[i][f"n_{k}"] == sum(s[0] == k for s in spans) for k in kinds)
    assert module.digest(frame(spark, [])).collect() == []


def test_pii_plan_is_native_and_adds_spans(spark):
    docs = frame(spark, ["Please call phone (555) 555-0147 now", "call tel 555-555-0147", "mail me: joe [at] example [dot] com"] * 30)
    plan = pii.candidates(docs, "text", "s")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    found = pii.find(docs.withColumn("pii_spans", F.lit(1))).select(F.explode("pii_spans").alias("s")).where("not s.base")
    assert found.count() > 0


def test_em_recovers_good_labelers():
    r = random.Random(2)
    counts = {}
    for _ in range(4000):
        y = r.random() < 0.3
        v = tuple((1 if (y if r.random() < q else not y) else -1) for q in (0.95, 0.9, 0.85, 0.6, 0.8))
        counts[v] = counts.get(v, 0) + 1.0
    prior, tables, _ = pii.reliabilities(list(counts.items()))
    assert abs(prior - 0.3) < 0.05 and tables[0][1][1] > tables[3][1][1]


def test_secret_battery_and_redaction(spark):
    r = random.Random(3)
    random_token = lambda a, n: "".join(r.choice(a) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [f"see {random_token(b64, 40)} and internationalisation" for _ in range(40)] + ["thinghewhththerewhereabouts " * 3, "password=abcdef12", None, "plain"]
    docs = frame(spark, texts)
    spans = {x["doc_id"]: x["spans"] for x in secrets.digest(docs).collect()}
    assert sum(spans[i].startswith("random:") for i in range(40)) >= 36 and spans[40] == "" and spans[43] == ""
    out = {x["doc_id"]: x for x in secrets.redact(docs).collect()}
    assert out[41]["text"] == "[SECRET]" and out[41]["n_chars"] == 8 and out[42]["text"] is None and out[43]["text"] == "plain" and len(out) == len(texts)


def test_media_round_trip(spark):
    texts = [None, "", "a", "é" * 33, "the same", "the same", "long text " * 20_000]
    out = media.digest(frame(spark, texts)).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        row = out.loc[i]
        assert row["n_bytes"] == len(raw) and row["payload_bytes"] == len(payload) and row["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert row["tail_crc32"] == zlib.crc32(payload[-64:]) and row["media_sha256"] == hashlib.sha256(media.to_wav(payload, 16_000)).hexdigest()
    assert (out.loc[4] == out.loc[5]).all()


def test_media_features(spark):
    import pyarrow as pa

    s = media.Settings()
    x = np.sin(np.arange(4000) * 0.05)
    assert np.abs(media.resample(x, 1, 2, 16)[100:-100] - x[::2][100:-100]).max() < 1e-3
    assert np.abs(media.resample(x, 3, 2, 16)[300:-300] - np.sin(np.arange(6000) * 0.05 * 2 / 3)[300:-300]).max() < 1e-3
    loud = bytes([128] * 8000) + bytes((128 + 100 * np.sin(np.arange(8000) * 0.3)).astype(np.uint8)) + bytes([128] * 16000)
    blocks, n, spans = media.features(loud, s)
    assert blocks.shape[1:] == (s.frames, s.mels) and len(spans) == 1 and abs(spans[0][0] - 8000 / 2 / s.hop) < 4
    table = pa.ipc.open_stream(media.ipc(media.tensor_batch(blocks, 0, s))).read_all()
    assert table.schema.field("log_mel").type.shape == [s.frames, s.mels] and table["end_s"][0].as_py() == s.frames * s.hop * 2 / s.rate
    audio = media.analyse(media.store(frame(spark, ["some text"]))).first()["audio"]
    assert audio["tensors"] and audio["n_frames"] >= 1


def naive_audio(payload, s):
    """Log-mel frames and active spans by sums over single samples and bins."""
    x = [(b - 128) / 128 for b in payload]
    size = -(-len(x) * s.up // s.down)
    span = s.taps * s.up
    h = [np.sinc(i / max(s.up, s.down)) * (0.5 - 0.5 * np.cos(2 * np.pi * (i + span + 1) / (2 * span + 1))) for i in range(-span, span)]
    y = []
    for m in range(size):
        at, phase = m * s.down // s.up, m * s.down % s.up
        w = [h[phase + j * s.up] for j in range(2 * s.taps)]
        y.append(sum(w[j] * x[at + s.taps - j] for j in range(2 * s.taps) if 0 <= at + s.taps - j < len(x)) / sum(w))
    n = 1 + max(0, -(-(len(y) - s.frame) // s.hop))
    y += [0.0] * max(0, (n - 1) * s.hop + s.frame - len(y))
    rate, mel = s.rate * s.up / s.down, lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(rate / 2) * i / (s.mels + 1) / 2595) - 1) for i in range(s.mels + 2)]
    win = [0.5 - 0.5 * np.cos(2 * np.pi * (i + 1) / (s.frame + 1)) for i in range(s.frame)]
    frames, energy = [], []
    for f in range(n):
        part = np.array([y[f * s.hop + i] * win[i] for i in range(s.frame)])
        power = [abs(sum(part * np.exp(-2j * np.pi * k * np.arange(s.frame) / s.frame))) ** 2 for k in range(s.frame // 2 + 1)]
        hz = [k * rate / s.frame for k in range(s.frame // 2 + 1)]
        tri = lambda a, b, c, v: max(0.0, min((v - a) / (b - a), (c - v) / (c - b)))
        frames.append([np.log(sum(p * tri(*edges[j : j + 3], v) for p, v in zip(power, hz)) + 1e-6) for j in range(s.mels)])
        energy.append(10 * np.log10((part**2).mean() + 1e-10))
    level, spans, on, quiet = np.median(energy), [], None, 0
    for i, e in enumerate(energy):
        if on is None:
            on, last = (i, i) if e >= level + s.on_db else (None, 0)
        elif e >= level + s.off_db:
            last = i
        elif i - last >= s.hold:
            spans.append((on, last + 1))
            on = None
    return np.array(frames), spans + ([(on, last + 1)] if on is not None else [])


@pytest.mark.parametrize("up,down", [(1, 2), (3, 2)])
def test_media_features_by_brute_force(up, down):
    r = random.Random(6)
    s = media.Settings(up=up, down=down, taps=4, frame=32, hop=16, mels=5, frames=8)
    payload = bytes(r.randint(100, 156) for _ in range(600)) + bytes(r.randint(0, 255) for _ in range(300)) + bytes([128] * 124)
    blocks, n, spans = media.features(payload, s)
    want, want_spans = naive_audio(payload, s)
    assert n == len(want) and np.abs(blocks.reshape(-1, s.mels)[:n] - want).max() < 2e-2 and spans == want_spans and not blocks.reshape(-1, s.mels)[n:].any()


def test_media_tables_edges(spark):
    assert media.digest(frame(spark, [])).collect() == []
    rows = frame(spark, ["a", "a", None]).withColumn("media", F.lit("x")).withColumn("audio", F.lit(1)).withColumn("n_bytes", F.lit("clash"))
    out = media.analyse(media.store(rows)).collect()
    assert len(out) == 3 and out[0]["audio"] == out[1]["audio"] and out[2]["audio"]["payload_bytes"] == 64 and out[0]["n_bytes"] == "clash"
    assert media.analyse(rows.select("doc_id", F.lit(None).cast("binary").alias("media"))).first()["audio"] is None
    got = media.digest(rows.unionByName(rows)).collect()
    assert len(got) == 6 and len({x["feature"] for x in got if x["doc_id"] in (0, 1)}) == 1


def test_bpe_is_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(1)
    parts = ["a", "aa", " ", "  ", "\n", "é", "ß", "1", ".", "'s", "'ll", "<|endoftext|>", "the", "ing", "漢", "😀", "　", "\x85", "\t", "=", "====="]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(300)] + ["a" * n for n in range(60)] + ["x" * 30_000, None, ""]
    coded = bpe.encode(frame(spark, texts).withColumn("ids", F.lit("clash")))
    back = {x["doc_id"]: x for x in bpe.decode(coded.withColumn("kept", F.col("ids")).withColumn("ids", F.col("ids"))).collect()}
    ids = {x["doc_id"]: x["ids"] for x in coded.collect()}
    for i, t in enumerate(texts):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert ids[i] == want and back[i]["text"] == lib.decode(want, skip_special_tokens=False)
    assert bpe.round_trip_digest(frame(spark, [])).collect() == []


@pytest.mark.parametrize("how", [{"page_rows": 64, "leaf_rows": 8, "sample_rows": 40, "pivots": 4}, {"page_rows": 16, "leaf_rows": 4, "sample_rows": 64, "chunk_queries": 5, "block_rows": 2}, {}])
def test_exact_search_is_brute_force(spark, how):
    r = np.random.default_rng(5)
    v = [r.normal(size=8).round(2).tolist() for _ in range(300)] + [[0.5] * 8] * 60
    rows = [(i, x) for i, x in enumerate(v)] + [(1000, None), (1020, [1.0, None] + [0.0] * 6), (1040, [float("nan")] * 8), (1060, [1.0, 2.0]), (None, [0.1] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("page", F.lit("clash"))
    got = {}
    for x in exact_search.top_k(df, F.col("vec_id") % 20 == 0, k=7, **how).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    whole = {i: np.floor(64 * np.array((x + [0.0] * 8)[:8])) for i, x in rows if i is not None and i not in (1000, 1020, 1040)}
    assert set(got) == {i for i in whole if i % 20 == 0}
    for q in got:
        best = sorted(((-int(whole[q] @ whole[i]), i) for i in whole if i != q))[:7]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert exact_search.top_k(df.limit(0), F.lit(True)).collect() == []
    few = exact_search.top_k(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert [x["rank"] for x in sorted(few)] == [1, 2, 3]
    same = spark.createDataFrame([(i, [1.0, 0.5]) for i in range(90)], "vec_id long, embedding array<double>")
    got = sorted(exact_search.top_k(same.unionByName(same.where("vec_id = 5")), F.col("vec_id") == 0, k=7, page_rows=16).collect())
    assert [x["vec_id"] for x in got] == [1, 2, 3, 4, 5, 5, 6]


def test_html_layout(spark):
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body>a<p>one<p>two &amp; <b>bold</b> end<ul><li>x<li>y<ol start=3><li>q<li>r</ol><li>z</ul>
    <table><tr><th>Name<th>Qty<tr><td>apple<td>10</table><pre>  keep
   this</pre><div style="display: none">no</div><span hidden>no</span>tail<br>line<script>var a="<p>no</p>";</script> end &lt; 3 <!-- no --></body></html>"""
    text = html_text.visible_text(page)
    assert "no" not in text.replace("now", "")
    assert "one\n\ntwo & bold end\n\n- x\n- y\n  3. q\n  4. r\n- z" in text
    assert "Name   Qty\napple  10" in text and "  keep\n   this" in text and text.endswith("tail\nline end < 3")
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<div>" * 30_000 + "x"), (4, "<" * 999), (5, '<a b="' + "x" * 50_000), (5, "plain")], "page_id long, html string")
    got = [x["text"] for x in html_text.extract(pages.withColumn("text", F.lit("clash"))).orderBy("page_id").collect()]
    assert got[:3] == ["", "", "x"] and "plain" in got and html_text.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("page,text", [
    ("<table><tr><form><td>text</td><td>b</td></form></tr></table>", "text  b"),
    ("<table>text<tr><td>cell</td></tr></table>", "text\n\ncell"),
    ("<table><tr>text<td>cell</td></tr></table>", "text\n\ncell"),
    ("<table><div>text</div><tr><td>cell</td></tr></table>", "text\n\ncell"),
    ("<table><tbody><p>one</p><p>two</p><tr><td>a</td><td>b</td></tr></tbody></table>end", "one\n\ntwo\n\na  b\n\nend"),
    ("<table><form><tr><td>a</td></tr><tr><td>b</td></tr></form></table>", "a\nb"),
    ("<table><tr><td>a <table>in<tr><td>b</td></tr></table></td></tr></table>", "a in b"),
    ("<table><tr><td>x</td></tr><span hidden>no</span></table>", "x"),
    ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p>", "a x=2 b"),
    (r"<p><math><mi>x</mi><annotation>\frac</annotation></math></p>", "x"),
    ("<p>a <svg><title>no</title><text>drawn</text></svg> b</p>", "a drawn b"),
    ('<p>a <span aria-hidden="true">seen</span></p>', "a seen"),
])
def test_html_text_outside_cells(page, text):
    assert html_text.visible_text(page) == text


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "secrets", "best_fit_packing"]
    clean = corpus_pipeline.drop_toxic(spark, docs, sf).cache()
    scored = toxicity.score(docs, toxicity.fit_on_labels(docs, spark.read.parquet(f"{sf}/labels.parquet"))).where("toxicity < 0.5")
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {r["doc_id"] for r in scored.select("doc_id").collect()}
    some = clean.where("doc_id < 300")
    rows = sorted(some.select("doc_id", "text").collect())
    groups, _ = near_groups([r["text"] for r in rows])
    kept = corpus_pipeline.drop_near_copies(spark, some, sf)
    assert sorted(r["doc_id"] for r in kept.collect()) == [rows[i]["doc_id"] for i, g in enumerate(groups) if g == i]
    hidden = corpus_pipeline.hide_secrets(spark, kept, sf)
    assert hidden.columns == docs.columns and hidden.count() == kept.count()
    assert not any(base_secrets(r["text"]) for r in hidden.collect())
    packed = corpus_pipeline.pack_sequences(spark, hidden, sf).toPandas()
    assert set(packed["doc_id"]) == {r["doc_id"] for r in hidden.collect()}


def test_pii_added_spans(spark):
    """Planted spans that no base pattern finds, and like forms that are none: precision and recall of what is added."""
    r = random.Random(11)
    docs = [x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    name = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9)))
    good = [
        lambda: f"please mail {name()}.{r.randint(1, 99)} [at] {name()} [dot] com", lambda: f"write to me: {name()}{r.randint(1, 99)} (at) {name()}.org",
        lambda: f"call my phone ({r.randint(201, 989)}) 555-{r.randint(0, 9999):04}", lambda: f"mobile: {r.randint(201, 989)}-555-{r.randint(0, 9999):04}",
        lambda: f"social security {r.randint(100, 600)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", lambda: f"signed by Dr. {r.choice(['Anna', 'Peter', 'Maria'])} {r.choice(['Miller', 'Weber', 'Smith'])}",
        lambda: f"address: {r.randint(1, 999)} {r.choice(['Main', 'Oak', 'Church'])} Street",
    ]
    bad = [
        lambda: f"look {r.choice(['back', 'only', 'up'])} at {name()}.then", lambda: f"order number {r.choice([0, 1])}{r.randint(10, 99)}-{r.randint(100, 199)}-{r.randint(0, 9999):04}",
        lambda: f"part code 9{r.randint(10, 99)}-{r.randint(10, 99)}-0000", lambda: f"version {r.randint(300, 999)}.{r.randint(0, 9)}.{r.randint(1000, 9999)}.0", lambda: f"item {r.randint(0, 1)}{r.randint(10**14, 10**15 - 1)}",
    ]
    texts, spans = [], []
    for i in range(420):
        kind, makers = (True, good) if i % 3 else (False, bad)
        before, plant = r.choice(docs)[:200], makers[i % len(makers)]()
        texts.append(f"{before} {plant} {r.choice(docs)[:100]}")
        spans.append((kind, len(before), len(before) + len(plant) + 1))
    found = {x["doc_id"]: [s for s in x["pii_spans"] if not s["base"]] for x in pii.find(frame(spark, texts)).collect()}
    hit = [any(s["start"] < b and a < s["end"] for s in found[i]) for i, (_, a, b) in enumerate(spans)]
    caught = sum(h for h, (kind, _, _) in zip(hit, spans) if kind)
    false = sum(h for h, (kind, _, _) in zip(hit, spans) if not kind)
    assert caught / sum(k for k, _, _ in spans) >= 0.9 and caught / (caught + false) >= 0.9


def test_pii_many_spans_in_order(spark):
    text = "ab a@b.cc 1.2.3.4 joe [at] x [dot] com " * 700 + "é 😀 " + "a@b.cc"
    row = pii.digest(frame(spark, [text, text])).collect()[1]
    spans = [s.split(":") for s in row["spans"].split(",")]
    assert row["n_email"] == 701 and row["n_ip"] == 700 and [int(s[1]) for s in spans] == sorted(int(s[1]) for s in spans)
    assert all(text[int(a) : int(b)] in ("a@b.cc", "1.2.3.4", "joe [at] x [dot] com") for _, a, b in spans)


def test_secrets_added_spans(spark):
    """Random tokens without a key word in ordinary documents, and words, numbers and names that look long: what the battery adds."""
    r = random.Random(13)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]
    docs = [x["text"] for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    decoys = ["internationalisierungen", "number_of_rows_in_the_table", "configuration-management", "HTTPConnectionPoolManager", "aaaaaaaaaaaaaaaaaaaa", "2024-01-31-2024-02-29"]
    texts, planted = [], []
    for i, t in enumerate(docs):
        token = "".join(r.choice(alphabets[i % 2]) for _ in range(r.choice([32, 40, 64]))) if i % 5 == 0 else r.choice(decoys)
        texts.append(f"{t} {token}")
        planted.append((i % 5 == 0, len(t) + 1))
    found = {x["doc_id"]: {s["start"] for s in x["secret_spans"] if not s["base"]} for x in secrets.find(frame(spark, texts)).collect()}
    caught = sum(at in found[i] for i, (secret, at) in enumerate(planted) if secret)
    added = sum(map(len, found.values()))
    assert caught / sum(s for s, _ in planted) >= 0.9 and caught / added >= 0.95


def test_secret_p_values_are_uniform_under_their_null():
    r = np.random.default_rng(3)
    place = 3 * len(secrets._ENCODINGS) + 8
    null = np.zeros(secrets._CELLS)
    cells = r.integers(0, secrets._CELLS, 40)
    np.add.at(null, cells, r.integers(1, 4000, 40))
    p = secrets.p_values(null, place)
    for q in (0.05, 0.2, 0.5):
        assert null[p <= q].sum() / null.sum() <= q + 0.05
    assert secrets.accepted({}, {}, 0.01) == [] and p.min() > 0


def test_secret_words_are_ascii():
    assert not secrets.candidates("paſſword=abcdef123") and not secrets.candidates("toKen: abcdef123") and secrets.candidates("PassWord=abcdef123")


@pytest.mark.parametrize("page,text", [
    ('<ol start="--5"><li>x</ol>', "1. x"),
    ('<ol start="-2"><li>x<li>y</ol>', "-2. x\n-1. y"),
    (f'<ol start="{"9" * 5000}"><li>x</ol>', "1000000000. x"),
    (f'<table><tr><td colspan="{"1" * 5000}">a<td>b<tr><td>c</table>', "a" + "  " * 100 + "b\nc"),
    ("<table><tr><td rowspan=2>A<td>b<tr><td>c<td>d</table>", "A  b\n   c  d"),
    ("<table><tr><td>a<td rowspan=3>B<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  B  c\nd     e\nf     g"),
    ("<table><thead><tr><td rowspan=9>h</thead><tbody><tr><td>a<td>b</table>", "h\na  b"),
    ('<div style="visibility:hidden">no<b style="visibility:visible">yes</b></div>', "yes"),
    ('<div style="display:none">no<b style="display:inline">no</b></div>a', "a"),
    ("<style>.x{display:none} p.y,#z{visibility:hidden} div{color:red}</style><p class=x>no</p><p class='a y'>no</p><div class=y>yes</div><p id=z>no</p>", "yes"),
    ("<style>b{display:none}</style><p>a<b>no</b>c</p>", "ac"),
    ("a &#99999999999; b&#" + "1" * 6000 + "; c &#x1F600;", "a � b� c 😀"),
    ("one <b two", "one"), ("1 < 2 and <3", "1 < 2 and <3"), ("<p title='a>b' x=\"c>d\">in</p>", "in"), ('<p x="open>in</p>', "in"),
    ("<a href=x/y>link</a><br/>end", "link\nend"),
])
def test_html_numbers_spans_and_visibility(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize("page", ["<a" * 100_000, "<a " * 100_000, '<a b="' * 60_000, "<a b='x\">" * 40_000, "<" * 200_000, "</" * 100_000, "<!" * 100_000, "<!--" * 50_000, "<td>" * 60_000, "<table>" * 40_000 + "x", "<ul><li>" * 30_000, "&#" * 100_000, "<a" + " " * 200_000, "<script>" * 30_000, "=" * 100_000, "<a " + "=" * 100_000 + ">b", "<table><tr><td>" + "x" * 200_000 + "<td>y" + "<tr><td>a<td>b" * 3000])
def test_html_hard_pages_take_no_time(page):
    import time

    began = time.thread_time()
    assert len(html_text.visible_text(page)) < 10 * len(page) + 10
    assert time.thread_time() - began < 4


def test_html_words_are_all_there():
    """Brute force on random well-formed pages: the words of all text, in order, are the words of the result but for list marks."""
    r = random.Random(21)

    def make(depth):
        if depth == 0 or r.random() < 0.3:
            return " ".join(r.choice(["one", "two", "three", "x&amp;y"]) for _ in range(r.randint(1, 4)))
        tag = r.choice(["p", "div", "span", "b", "ul", "blockquote", "section"])
        parts = [make(depth - 1 if tag != "p" else 0) for _ in range(r.randint(1, 3))]
        return f"<ul>{''.join(f'<li>{x}</li>' for x in parts)}</ul>" if tag == "ul" else f"<{tag}>{' '.join(parts)}</{tag}>"

    for _ in range(200):
        page = make(4)
        want = re.sub(r"<[^>]*>", lambda m: "" if m[0].strip("</>") in ("span", "b") else " ", page).replace("&amp;", "&").split()
        got = [w for w in html_text.visible_text(page).split() if w != "-"]
        assert got == want, page


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, repeated rows and ids, clashing columns and empty tables through every stage."""
    import corpus_pipeline

    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, "en", "s", 3), (1, words, "en", "s", 3), (None, words, None, None, None), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "password=abcdef123 " + words + " tail", "en", "s", 9), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("clash")).withColumn("__spans", F.lit(1)).withColumn("row", F.lit(2.5)).withColumn("toxicity", F.lit("x"))
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, now, SF)
        if name == "best_fit_packing":
            got = out.toPandas()
            assert len(got) == now.count() and got["length"].min() == 1
            break
        assert set(out.columns) == set(docs.columns), name
        now = spark.createDataFrame(out.collect(), out.schema)
        ids = sorted(str(r["doc_id"]) for r in now.collect())
        if name == "toxicity":
            assert len(ids) == len(rows)
        else:  # the row without an id is a copy of document 1, document 4 a near copy
            assert ids == ["1", "1", "2", "3", "None"]


def test_pipeline_runs_and_deletes_what_it_read(spark, tmp_path):
    import os

    import corpus_pipeline
    from docstrata.sources.shared import shared_folder

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    secret = spark.createDataFrame([(900, "token: abcdef1234567 " + "x y z " * 30, "en", "s", 9)], SCHEMA)
    docs.unionByName(secret.select(*docs.columns)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    held = lambda: set(os.listdir(shared_folder(spark).removeprefix("file://")))
    before = held()
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r["doc_id"] for r in out.collect()}
    assert len(held() - before) == 1 and before <= held()  # the result alone
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    model = toxicity.fit_on_labels(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    ids = sorted(i for i, s in zip(texts, model.scores(list(texts.values()))) if s < 0.5)
    groups, _ = near_groups([texts[i] for i in ids])
    assert kept == {i for k, i in enumerate(ids) if groups[k] == k}
    redacted = sum(len(r.encode()) + 1 for r in (secrets_gone(texts[i]) for i in kept))
    assert sum(r["length"] for r in out.collect()) == redacted


def secrets_gone(text):
    """Base spans replaced, leftmost first, by hand."""
    at, out = 0, ""
    for _, a, b in sorted(base_secrets(text), key=lambda s: s[1]):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_longer_windows_are_made_of_their_halves(monkeypatch):
    """Windows of 32, 48, 64 and 128 characters compare only pairs across their halves; counts are those of each window by itself."""
    r = random.Random(6)
    pieces = ["".join(r.choice("abAB 019_.é") for _ in range(n)).encode() for n in (5, 40, 130, 700, 1_500)]
    seen, plain = [], secrets._equal_pairs

    def pairs(columns, halves=None):
        seen.append((len(columns), halves is not None))
        out = plain(columns, halves)
        assert out.tolist() == [sum(a == b for i, a in enumerate(w) for b in w[:i]) for w in columns.T.tolist()]
        return out

    monkeypatch.setattr(secrets, "_equal_pairs", pairs)
    secrets._count_windows(pieces, np.zeros(len(secrets._LENGTHS) * len(secrets._ENCODINGS) * secrets._CELLS, np.int64))
    assert {n for n, reused in seen if reused} == {32, 48, 64, 128} and {n for n, reused in seen if not reused} == {16, 20, 24}


def test_texts_are_looked_through_before_the_patterns(monkeypatch):
    """A pattern runs only over texts that can hold it, and finds what it finds in all of them."""
    r = random.Random(7)
    bits = ["password", "PassWd", "toKen", "apikey", "API_KEY", "=", ":", '"', " ", "AKIA", "ab12" * 6, "ABCDEFGH12345678", "é", "ſecret", "\ud800", "x" * 15, "/+=_-.", "\n"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(2_000)]
    for text in texts:
        found = [("assign", m.start(), m.end()) for m in secrets._ASSIGN.finditer(text) if len(m[1]) >= 6]
        found += [(kind, m.start(), m.end()) for kind, p in (("access", secrets._ACCESS), ("hex", secrets._HEX)) for m in p.finditer(text)]
        own = [m.span() for m in secrets._RUN.finditer(text)]
        found += [("random", a, b) for a, b in own if not any(s < b and a < e for _, s, e in found)]
        assert sorted(x[:3] for x in secrets.candidates(text)) == sorted(found)
    for name in ("_ASSIGN", "_ACCESS", "_HEX", "_RUN"):
        monkeypatch.setattr(secrets, name, None)
    assert secrets.candidates("a: long text = of words shorter than sixteen letters") == []
