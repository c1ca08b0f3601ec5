"""N-gram Jaccard join over a prefix tree.

Documents become sets of word n-grams (64-bit hashes); equal sets become one *node*. Two routes find every pair of
nodes that can reach the threshold, without listing the pairs of a group:

* The *zone*: of each set, the n-grams whose hash lies below a bound, which falls as sets grow and leaves more than
  the prefix that the prefix filter asks for. An n-gram in more than ``light`` zones is heavy; all others come first
  in the global order. Nodes that share a light n-gram are counted by pair, and the count with the lengths bounds
  their overlap; pairs which that bound excludes go.
* A node whose zone has too few light n-grams (most of its text is common to many documents) is joined, through the
  n-grams of its prefix in hash order, with the other such nodes: the prefix filter under that plainer order.

Connected candidates form groups. Inside a group the sets are stored in a tree, n-grams in one global order; a block of
sets walks it, all sets of the block sharing the overlap counted so far on a path, and subtrees go as soon as the rest
of the path cannot bring any of them to the threshold. Large groups are dealt out in blocks by *slack* (a ninth of the
size less the n-grams nobody else has): at 0.8, two sets link only if their slacks sum to 0 or more.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.shared import components, forget, parts, slices, table

_BASE = np.uint64(0x100000001B3)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEGMENT = 1 << 16
_BROADCAST_ROWS = 1_000_000  # of at most six columns of a number; more rows are shuffled
_GRAMS_AT_ONCE = 2_000_000  # of small groups that one task takes, one group after another


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as the longest word needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            size = max(n, _SEGMENT * 2)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]), dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def _segment_words(raw: np.ndarray) -> np.ndarray:
    gap = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _POWERS.upto(len(raw))
    total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
    return _mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _MIX[0])


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each word ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z in lower case."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    if len(raw) <= 2 * _SEGMENT:
        return _segment_words(raw)
    found, at = [], 0
    while at < len(raw):
        stop = min(at + _SEGMENT, len(raw))
        while stop < len(raw):  # a word stays in one piece
            space = np.flatnonzero(_SPACE[raw[stop : stop + _SEGMENT]])
            if len(space):
                stop += int(space[0])
                break
            stop = min(stop + _SEGMENT, len(raw))
        found.append(_segment_words(raw[at:stop]))
        at = stop
    return np.concatenate(found)


def ngram_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams; a text of fewer words is one n-gram; no words, no n-gram."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    k = min(width, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ words[j : len(words) - k + 1 + j]) * _MIX[0]
        h ^= h >> np.uint64(29)
    h = np.sort(_mixed(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def node_of(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _zone_share(n: float, t: float) -> float:
    """The share of hashes that are in the zone of a set of ``n``: its prefix and some spare."""
    return 1.0 if n < 1 else min(1.0, (1 - t) + 0.01 + 1.8 / math.sqrt(n) + 1 / n)


def _below(grams: np.ndarray, share: float) -> int:
    return len(grams) if share >= 1 else int(np.searchsorted(grams, np.uint64(int(share * 2**64))))


def _prefix(n: int, num: int, den: int) -> int:
    return n + (-num * n // den) + 1


def _sets(num: int, den: int, width: int):
    """Rows with a text to rows with the identity of its set, and the zone of the set at its first row in the task."""
    t = num / den
    schema = pa.schema([
        ("doc_id", pa.int64()), ("tkey", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("spare", pa.int64()), ("held", pa.int64()), ("zone", pa.list_(pa.int64())),
    ])

    def run(batches):
        first = set()
        for part in slices(batches, "text"):
            out = ([], [], [], [], [])
            for text in part.column("text").to_pylist():
                grams = ngram_set(text, width)
                n = len(grams)
                node = node_of(grams)
                out[0].append(n)
                out[1].append(node)
                if not n or node in first:
                    for column in out[2:]:
                        column.append(None)
                    continue
                first.add(node)
                prefix, held = _prefix(n, num, den), _below(grams, _zone_share(t * n, t))
                out[2].append(_below(grams, _zone_share(n, t)) - prefix)
                out[3].append(held)
                out[4].append(grams[: max(held, prefix)].view(np.int64).copy())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tkey"), *(pa.array(x, f.type) for x, f in zip(out, list(schema)[2:]))], schema=schema)

    return run


def _grams(width: int):
    """Rows with a text to the n-grams of their node, once in a task; a row whose text is not that of its node goes (a key may repeat)."""
    schema = pa.schema([("node", pa.int64()), ("grp", pa.int64()), ("large", pa.bool_()), ("n", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches):
        done = set()
        for part in slices(batches, "text"):
            keep, lists = [], []
            for i, (text, node) in enumerate(zip(part.column("text").to_pylist(), part.column("node").to_pylist())):
                if node not in done:
                    grams = ngram_set(text, width)
                    if node_of(grams) == node:
                        done.add(node)
                        keep.append(i)
                        lists.append(grams.view(np.int64))
            named = [part.column(c).take(pa.array(keep, pa.int64())) for c in ("node", "grp", "large")]
            yield pa.RecordBatch.from_arrays([*named, pa.array(map(len, lists), pa.int64()), pa.array(lists, pa.list_(pa.int64()))], schema=schema)

    return run


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def tree_links(probes: list[np.ndarray], stored: list[np.ndarray], num: int, den: int, probe_rows: int = 128):
    """Pairs (probe, stored) with ``den * |intersection| >= num * |union|``.

    The stored sets form a tree in one global order: n-grams of many stored sets first, so that near copies share long
    paths. Each node of the tree is entered once for a block of probes; those that can still reach the threshold
    (overlap so far, what remains below, what remains of the probe) go on.
    """
    if not probes or not stored:
        return
    flat = np.concatenate(stored)
    vocab, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.empty(len(vocab), np.int64)
    order[np.lexsort((vocab, -count))] = np.arange(len(vocab))
    ends = np.cumsum([len(x) for x in stored])
    paths = [np.sort(order[x]) for x in np.split(code, ends[:-1])]
    rank = sorted(range(len(paths)), key=lambda i: paths[i].tobytes() if len(paths[i]) == 0 else paths[i].astype(">u8").tobytes())
    sizes = np.array([len(x) for x in paths])
    # in sorted order, the tokens which a path shares with the one before; a path's subtree is a run of this order
    common = [0] * (len(rank) + 1)
    for r in range(1, len(rank)):
        x, y = paths[rank[r - 1]], paths[rank[r]]
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[:m] != y[:m])
        common[r] = int(differ[0]) if len(differ) else m

    for at in range(0, len(probes), probe_rows):
        block = probes[at : at + probe_rows]
        n = np.array([len(x) for x in block])
        place = [np.searchsorted(vocab, x) for x in block]
        has = np.zeros((len(vocab), len(block)), bool)
        for j, (p, x) in enumerate(zip(place, block)):
            p = np.minimum(p, len(vocab) - 1)
            has[order[p[vocab[p] == x]], j] = True

        stack = [(0, len(rank), 0, np.arange(len(block)), np.zeros(len(block), np.int64))]
        while stack:
            lo, hi, depth, alive, got = stack.pop()
            edge = min(common[lo + 1 : hi]) if hi - lo > 1 else len(paths[rank[lo]])
            if edge > depth:
                got = got + has[paths[rank[lo]][depth:edge]][:, alive].sum(0)
                depth = edge
            below = sizes[[rank[r] for r in range(lo, hi)]]
            # least size of a partner in this subtree, and the most that may still match
            rest = int(below.max()) - depth
            need = num * (n[alive] + int(below.min()))
            keep = (got + np.minimum(rest, n[alive] - got)) * (num + den) >= need
            keep &= den * n[alive] >= num * int(below.min())
            keep &= den * int(below.max()) >= num * n[alive]
            alive, got = alive[keep], got[keep]
            if not len(alive):
                continue
            r = lo
            while r < hi and sizes[rank[r]] == depth:  # paths that end here
                hit = got * (num + den) >= num * (n[alive] + depth)
                for j in alive[hit]:
                    yield at + int(j), rank[r]
                r += 1
            while r < hi:
                end = r + 1
                while end < hi and common[end] > depth:
                    end += 1
                stack.append((r, end, depth, alive, got))
                r = end


def _as_sets(column) -> list[np.ndarray]:
    return [np.asarray(x, np.int64).view(np.uint64) for x in column]


def _group_links(num: int, den: int):
    """A forest over each candidate group; rows come group by group, and only one group is held at a time."""

    def run(batches):
        def told():
            a, b, known = [], [], _Union(len(nodes))
            for i, j in tree_links(sets, sets, num, den):
                if i != j and known.join(i, j):
                    a.append(nodes[i])
                    b.append(nodes[j])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        now, nodes, sets = None, [], []
        for batch in batches:
            for group, node, grams in zip(batch.column("grp").to_pylist(), batch.column("node").to_pylist(), batch.column("grams")):
                if group != now:
                    if len(nodes) > 1:
                        yield told()
                    now, nodes, sets = group, [], []
                nodes.append(node)
                sets.append(grams.values.to_numpy().view(np.uint64).copy())
        if len(nodes) > 1:
            yield told()

    return run


def _block_links(num: int, den: int):
    """A forest over the links between two blocks of a large group (side 0 walks the tree of side 1)."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        left, right = (frame[frame["side"] == s] for s in (0, 1))
        right = left if not len(right) else right
        names = {x: i for i, x in enumerate(pd.unique(frame["node"]))}
        known, a, b = _Union(len(names)), [], []
        ln, rn = left["node"].to_numpy(), right["node"].to_numpy()
        for i, j in tree_links(_as_sets(left["grams"]), _as_sets(right["grams"]), num, den):
            if ln[i] != rn[j] and known.join(names[ln[i]], names[rn[j]]):
                a.append(ln[i])
                b.append(rn[j])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def _large_groups(sets: DataFrame, num: int, den: int, block_rows: int) -> DataFrame:
    """Links inside groups too large for a task. ``sets``: grp, node, n, grams. Two passes over pairs of blocks.

    Blocks hold nodes of like slack. The first pass joins the blocks of the highest slack in a group with all of its
    blocks; the second joins those pairs of blocks whose slacks allow a link and that are not one component by then.
    """
    spark = sets.sparkSession
    tokens = sets.select("grp", "node", F.explode("grams").alias("gram"))
    alone = tokens.groupBy("grp", "gram").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1")
    own = alone.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    # sizes n and m link only if |difference| <= (den - num) / (den + num) * (n + m)
    slack = F.floor(F.col("n") * (den - num) / F.lit(float(den + num)) - F.coalesce("own", F.lit(0)) + 1e-6)
    band = (F.floor(slack / 4) * 4 + 3).cast("long")
    rated = sets.select("grp", "node", "n").join(own, "node", "left").withColumn("band", band)
    best = rated.groupBy("grp").agg(F.max("band").alias("top"))
    sizes = rated.groupBy("grp", "band").agg(F.ceil(F.sum(F.greatest(F.lit(1.0), F.col("n") / 400)) / block_rows).alias("salts"))
    dealt, dealt_path = table(
        rated.join(best, "grp").where("band + top >= 0").join(sizes, ["grp", "band"])
        .select("grp", "node", "band", "top", F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"))
    )
    blocks = dealt.groupBy("grp", "band", "salt", "top").agg(F.count(F.lit(1)).alias("rows"))
    left, right = (blocks.select("grp", "top", *(F.col(c).alias(f"{c}_{s}") for c in ("band", "salt"))) for s in (0, 1))
    pairs = left.join(right.drop("top"), "grp").where(
        "band_0 + band_1 >= 0 and struct(band_0, salt_0) <= struct(band_1, salt_1)"
    )
    full = sets.select("node", "grams")

    def joined(wanted: DataFrame) -> DataFrame:
        sides = [
            wanted.select("grp", "band_0", "salt_0", "band_1", "salt_1", F.lit(s).alias("side"), F.col(f"band_{s}").alias("band"), F.col(f"salt_{s}").alias("salt"))
            for s in (0, 1)
        ]
        own_pair = "side = 0 or band_0 <> band_1 or salt_0 <> salt_1"
        rows = sides[0].unionByName(sides[1]).where(own_pair).join(dealt.drop("top"), ["grp", "band", "salt"]).join(full, "node")
        return (
            rows.select("grp", "band_0", "salt_0", "band_1", "salt_1", "side", "node", "grams")
            .groupBy("grp", "band_0", "salt_0", "band_1", "salt_1")
            .applyInPandas(_block_links(num, den), "a long, b long")
        )

    hubs = pairs.where("band_1 = top and salt_1 = 0")
    first, first_path = table(joined(hubs))
    comp = components(first)
    state = dealt.join(comp, "node", "left").select("grp", "band", "salt", F.coalesce("comp", "node").alias("comp"))
    pure = state.groupBy("grp", "band", "salt").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    later = pairs.where("not (band_1 = top and salt_1 = 0)")
    for s in (0, 1):
        later = later.join(pure.select("grp", *(F.col(c).alias(f"{c}_{s}") for c in ("band", "salt", "low", "high"))), ["grp", f"band_{s}", f"salt_{s}"])
    later = later.where("least(low_0, low_1) <> greatest(high_0, high_1)")
    second, _ = table(first.unionByName(joined(later)))
    forget(spark, first_path, dealt_path)
    return second


def jaccard_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: tuple[int, int] = (80, 100),
    light: int = 32, block_rows: int = 512,
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of each row of ``docs``.

    Documents link when ``threshold[1] * |intersection| >= threshold[0] * |union|`` of their n-gram sets;
    ``component_id`` is the smallest id that links reach. Exact: no candidate is dropped unless a bound excludes it.

    Null or empty texts and texts without words have no n-grams and link with nothing (their own id is the component);
    equal sets link; rows with a null id link like others (their component is null if it has no id at all); rows that
    repeat an id are each returned. An empty table gives an empty result. Other columns of ``docs`` are not read.
    Hashes of n-grams and of sets have 64 bits.
    """
    out = _joined(docs, id_col, text_col, width, threshold, light, block_rows)
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tkey"), text.alias("text"))


def _joined(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: tuple[int, int], light: int, block_rows: int) -> DataFrame:
    """``doc_id``, ``tkey`` (a hash of the text), ``n_shingles`` and ``component_id`` of each row."""
    spark = docs.sparkSession
    num, den = threshold
    base = _keyed(docs, id_col, text_col)
    rows, rows_path = table(
        base.mapInArrow(_sets(num, den, width), "doc_id long, tkey long, n_shingles long, node long, spare long, held long, zone array<long>")
    )
    members = rows.select("doc_id", "tkey", "n_shingles", "node")

    # Of each n-gram the first light + 1 nodes: where there are more it is heavy, and how many more does not matter. The
    # limit is applied before the shuffle, so an n-gram that everybody has sends only so many rows from each task.
    zones = rows.where(F.col("zone").isNotNull())
    by_gram = Window.partitionBy("gram")
    ranked = zones.select("node", F.explode("zone").alias("gram")).withColumn("r", F.dense_rank().over(by_gram.orderBy("node"))).where(F.col("r") <= light + 1)
    often, often_path = table(ranked.withColumn("c", F.max("r").over(by_gram)).where("c > 1").select("node", "gram", "c"))

    many, many_path = table(often.where(F.col("c") > light).select("gram").distinct())
    if many.count() <= _BROADCAST_ROWS:
        many = F.broadcast(many)
    heavy = zones.select("node", F.explode("zone").alias("gram")).join(many, "gram").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("heavy"))
    whose = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", "tkey").alias("own"), F.col("tkey")))  # the row whose text stands for the node
    nodes, nodes_path = table(
        zones.groupBy("node").agg(F.max("n_shingles").alias("n"), F.max("spare").alias("spare"), F.max("held").alias("held"), whose.alias("row"))
        .join(heavy, "node", "left")
        .select("node", "n", "row.own", "row.tkey", (F.col("held") - F.coalesce("heavy", F.lit(0))).alias("lit"), (F.col("spare") < F.coalesce("heavy", F.lit(0))).alias("common"))
    )
    lists = often.where(F.col("c") <= light).groupBy("gram").agg(F.array_sort(F.collect_set("node")).alias("v"))
    first = lists.select("v", F.posexplode("v").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("lit").alias(f"lit{s}"))
    # what the larger of two sets shares outside its light n-grams, at most
    large_lit = F.when(F.col("na") > F.col("nb"), F.col("na") - F.col("lita")).when(F.col("na") < F.col("nb"), F.col("nb") - F.col("litb")).otherwise(F.least(F.col("na") - F.col("lita"), F.col("nb") - F.col("litb")))
    near = (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
        .where((F.col("c") + large_lit) * (num + den) >= (F.col("na") + F.col("nb")) * num)
        .select("a", "b")
    )

    common = nodes.where("common").select("node", "n")
    head = (F.col("n") - F.ceil(F.col("n") * num / F.lit(float(den)) - 1e-9) + 1).cast("int")
    prefix = zones.select("node", "zone").join(common, "node").select("node", F.explode(F.slice("zone", F.lit(1), head)).alias("gram"))
    prefix, prefix_path = table(prefix.distinct())
    # a table, so that the join reads both sides from shuffles and Spark can split what one n-gram brings
    hub, hub_path = table(prefix.groupBy("gram").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    spokes = prefix.join(hub, "gram").select("a", F.col("node").alias("b")).where("a <> b").distinct()
    groups, groups_path = table(components(near.unionByName(spokes)).join(nodes.select("node", "n", "own", "tkey"), "node"))

    weight = groups.groupBy("comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("grams_n"))
    is_large = (F.col("rows") > block_rows) | ((F.col("grams_n") > 400 * block_rows) & (F.col("rows") > 2))
    route, route_path = table(groups.join(weight.withColumn("large", is_large), "comp").select("node", F.col("comp").alias("grp"), "large", "n", "own", "tkey"))
    small_grams = route.where(~F.col("large")).agg(F.sum("n").alias("n")).first()["n"] or 0
    small_route = F.broadcast(route) if route.count() <= _BROADCAST_ROWS else route
    sets, sets_path = table(
        base.withColumn("own", F.coalesce("doc_id", "tkey")).join(small_route, ["own", "tkey"]).select("node", "grp", "large", "text")
        .mapInArrow(_grams(width), "node long, grp long, large boolean, n long, grams array<long>")
    )
    small = sets.where("not large").select("grp", "node", "grams").repartition(parts(spark, small_grams, _GRAMS_AT_ONCE), "grp").sortWithinPartitions("grp")
    links, links_path = table(small.mapInArrow(_group_links(num, den), "a long, b long"))
    big = sets.where("large").select("grp", "node", "n", "grams")
    if not big.isEmpty():
        links = links.unionByName(_large_groups(big, num, den, block_rows))
    comp = components(links)

    labels = members.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    labels = labels.join(comp, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp"))
    least = labels.groupBy("comp").agg(F.min("least").alias("component_id"))
    named_comp, _ = table(labels.join(least, "comp").select("node", "component_id"))  # a table, so that copies of one text can be split over tasks
    forget(spark, often_path, many_path, prefix_path, hub_path, groups_path, route_path, sets_path, links_path)
    return members.join(named_comp, "node", "left").select("doc_id", "tkey", "n_shingles", "component_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: tuple[int, int] = (80, 100), light: int = 32, block_rows: int = 512) -> DataFrame:
    """One document of each linked group stays: the one with the smallest id. Columns as in ``docs``.

    Of rows that repeat the smallest id, all stay. Rows with a null id go if a document with an id is in their group;
    in a group without any id nothing tells one from another, so all stay. Texts without words stay.
    """
    found, path = table(_joined(docs, id_col, text_col, width, threshold, light, block_rows))
    own = docs.withColumn("__id", F.col(id_col).cast("long"))
    first = found.where("doc_id = component_id or n_shingles = 0").select(F.col("doc_id").alias("__id")).where("__id is not null").distinct()
    kept = own.where("__id is not null").join(first, "__id", "left_semi")
    gone = found.where("doc_id is null and component_id is not null").select(F.col("tkey").alias("__tkey")).distinct()
    text = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    unnamed = own.where("__id is null").withColumn("__tkey", text).join(gone, "__tkey", "left_anti")
    return kept.select(*docs.columns).unionByName(unnamed.select(*docs.columns))
