"""The prefix trie of conversations, from double-array tries of shards.

Each node of the trie is a distinct beginning of conversations. A beginning is known by two 64-bit sums (exclusive or) of
hashes of its turns and their places, so equal beginnings meet by grouping alone; results are exact but for collisions of
these 128 bits. Conversations that are equal become one unit first. Nodes with many turns below them are shared: the units
below such a node, and below no deeper one, are dealt to shards by their next turn, each shard packs its units into a
double array and walks it, and what the shards say of the shared nodes is summed over all. Depths go in levels, the deepest
first, so a unit holds a bounded number of turns however long a conversation is.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.shared import forget, parts, table

SHARD_TURNS = 20_000  # beyond that many turns below it a node is shared by several shards
LEVEL_TURNS = 4_096  # most turns of a unit
_BLOCK_IDS = 10_000
_MOST_PARTS = 10_000
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long"


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family: CRC-32 of its decimal id modulo 4."""
    return F.crc32(conv.cast("string").cast("binary")) % 4


def rebuilt(conversations: DataFrame, *, family: int = 20) -> tuple[DataFrame, DataFrame, str]:
    """Turns of the rebuilt conversations (``conv_id``, ``pos`` from 1, ``turn_key``, ``words``), all ids (``conv_id``), and the path
    of the table that both read.

    Turns go by ``turn`` (null first), equal ones by the digest of role and text; null roles and texts are empty. Rows
    without a ``conv_id`` belong to no conversation. ``turn_key`` is a 128-bit digest of role and text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("turn_key"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"),
    )
    own_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_key")
    turns, path = table(rows.withColumn("own", F.row_number().over(own_order)).drop("turn"))
    ids = turns.where("own = 1").select("conv_id")
    first = turns.where("own <= 3").select(F.col("conv_id").alias("base"), F.col("own").alias("place"), "turn_key", "words")
    heads = (
        ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(first, "base")
        .where(F.col("place") <= shared_turns(F.col("conv_id"))).select("conv_id", F.lit(0).alias("part"), "place", "turn_key", "words")
    )
    tails = turns.where(F.col("own") > shared_turns(F.col("conv_id"))).select("conv_id", F.lit(1).alias("part"), F.col("own").alias("place"), "turn_key", "words")
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "place")).cast("long")
    return heads.unionByName(tails).select("conv_id", pos.alias("pos"), "turn_key", "words"), ids, path


class DoubleArray:
    """A trie of sequences of codes from 1 on: the child of slot s by code c is slot t = base[s] + c if check[t] == s."""

    def __init__(self, sequences: list[list[int]]):
        """``sequences`` are sorted and distinct."""
        self.base, self.check = array("q", [0]), array("q", [0])
        self._next = array("q", [1])  # a free slot at or after this one, by way of others
        self.size = 1
        stack = [(0, 0, len(sequences), 0)]
        while stack:
            slot, low, high, depth = stack.pop()
            while low < high and len(sequences[low]) <= depth:
                low += 1
            if low == high:
                continue
            starts = [low]
            for i in range(low + 1, high):
                if sequences[i][depth] != sequences[i - 1][depth]:
                    starts.append(i)
            codes = [sequences[i][depth] for i in starts]
            base = self.base[slot] = self._place(codes)
            for k, code in enumerate(codes):
                to = base + code
                self.check[to] = slot
                self._next[to] = to + 1
                self.size = max(self.size, to + 1)
                stack.append((to, starts[k], starts[k + 1] if k + 1 < len(starts) else high, depth + 1))

    def _free(self, slot: int) -> int:
        self._grow(slot)
        nxt = self._next
        while nxt[slot] != slot:
            after = nxt[slot]
            if after >= len(nxt):
                self._grow(after)
            nxt[slot] = nxt[after]
            slot = nxt[slot]
            self._grow(slot)
        return slot

    def _grow(self, slot: int) -> None:
        if slot >= len(self.check):
            old, new = len(self.check), max(slot + 1, 2 * len(self.check))
            self.base.extend([0] * (new - old))
            self.check.extend([-1] * (new - old))
            self._next.extend(range(old, new))

    def _place(self, codes: list[int]) -> int:
        """The least base, of the first few, whose slots are all free; else one beyond all that is taken."""
        at = self._free(codes[0] + 1)
        for _ in range(32):
            base = at - codes[0]
            self._grow(base + codes[-1])
            if all(self.check[base + c] < 0 for c in codes):
                return base
            at = self._free(at + 1)
        base = max(1, self.size - codes[0])
        self._grow(base + codes[-1])
        return base

    def walk(self, sequence: list[int]) -> list[int]:
        """The slots on the way of a sequence, as far as the trie has it."""
        slot, found = 0, []
        for code in sequence:
            to = self.base[slot] + code
            if code < 1 or to >= len(self.check) or self.check[to] != slot:
                break
            slot = to
            found.append(slot)
        return found


def _shard_nodes(units: list[dict]) -> tuple[list[tuple], tuple]:
    """All nodes of a shard below its shared node, and what the shard adds to that node."""
    dense: dict[bytes, int] = {}
    units = sorted(((([dense.setdefault(t["turn_key"], len(dense) + 1) for t in u["turns"]]), u) for u in units), key=lambda x: x[0])
    trie = DoubleArray([codes for codes, _ in units])
    shared = units[0][1]["shared"]
    node: dict[int, list] = {0: [shared["conv_id"], shared["depth"], None, 0, 0, 0, 0, None, 0]}
    order = []
    for codes, unit in units:
        up = 0
        for slot, turn in zip(trie.walk(codes), unit["turns"]):
            known = node.get(slot)
            if known is None:
                known = node[slot] = [unit["conv_id"], turn["pos"], up, 0, 0, 0, 0, None, turn["words"]]
                order.append(slot)
            known[0] = min(known[0], unit["conv_id"])
            known[3] += unit["n"]
            up = slot
        last = node[up]
        last[7] = unit["ends"]
        for i, more in enumerate(("n_children", "n_leaves", "saved_tokens")):
            last[4 + i] += unit[more] or 0
    for slot in order:
        node[node[slot][2]][4] += 1
    for slot in reversed(order):  # children come after their parents
        x = node[slot]
        x[5] += not x[4]
        x[6] += (x[3] - 1) * x[8]
        up = node[x[2]]
        up[5] += x[5]
        up[6] += x[6]
    rows = [(x[0], x[1], node[x[2]][0], x[3], x[4], x[5], x[6], x[7]) for x in (node[s] for s in order)]
    top = node[0]
    return rows, (top[4], top[5], top[6], top[7])


def _walk_shards(units: DataFrame, tasks: int) -> DataFrame:
    """Nodes of all shards; rows with ``k1`` and ``k2`` are what a shard adds to the shared node of that key."""
    schema = f"k1 long, k2 long, {_NODE}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        now, held = None, []

        def told():
            rows, top = _shard_nodes(held)
            key = held[0]["shared"]
            rows = [(None, None, *r) for r in rows] + [(key["k1"], key["k2"], None, None, None, None, *top)]
            for low in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[low : low + 10_000])], names=names)

        for batch in batches:
            for unit in batch.to_pylist():
                shard = unit["shared"]["k1"], unit["shared"]["k2"], unit["bucket"]
                if held and shard != now:
                    yield from told()
                    held = []
                now = shard
                held.append(unit)
        if held:
            yield from told()

    k1, k2 = F.col("shared.k1"), F.col("shared.k2")
    return units.repartition(tasks, k1, k2, "bucket").sortWithinPartitions(k1, k2, "bucket").mapInArrow(run, schema)


def _ends(members: DataFrame, rows: int) -> DataFrame:
    """``ends``, the smallest id of those with one key, and ``ends_sha256`` of all their ids in order.

    Ids are joined in ranges of (key, id), so a key of many ids is spread over tasks; SHA-256 itself has to read the joined
    blocks one after another, which one task does block by block.
    """

    def join(batches):
        key, ids = None, []

        def block():
            return pa.RecordBatch.from_pylist([{"k1": key[0], "k2": key[1], "first": ids[0], "ids": ",".join(map(str, ids))}], pa.schema(fields))

        fields = [("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]
        for batch in batches:
            blocks = []
            for *k, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (k != key or len(ids) >= _BLOCK_IDS):
                    blocks.append(block())
                    ids = []
                key = k
                ids.append(conv)
            if blocks:
                yield pa.Table.from_batches(blocks).combine_chunks().to_batches()[0]
        if ids:
            yield block()

    def digest(batches):
        key, first, sha = None, None, None
        names = ["ends", "ends_sha256"]
        for batch in batches:
            done = []
            for k1, k2, start, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (k1, k2) != key:
                    if sha is not None:
                        done.append((first, sha.hexdigest()))
                    key, first, sha = (k1, k2), start, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([sha.hexdigest()])], names=names)

    tasks = min(_MOST_PARTS, parts(members.sparkSession, rows, 200_000))
    blocks = members.select("k1", "k2", "conv_id").repartitionByRange(tasks, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(join, "k1 long, k2 long, first long, ids string")
    return blocks.repartition(tasks, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(digest, "ends long, ends_sha256 string")


def _level(turns: DataFrame, tops: DataFrame, low: int, level_turns: int, shard_turns: int, deeper: DataFrame | None):
    """Nodes at depths from ``low`` + 1 to ``low`` + ``level_turns``, and what they add to the nodes at depth ``low``.

    ``tops`` has the nodes at depth ``low`` (``k1``, ``k2``, ``conv_id``), ``deeper`` what the next level adds to those at its start.
    """
    high, paths = low + level_turns, []

    def kept(df):
        df, path = table(df)
        paths.append(path)
        return df

    rows = turns.where(F.col("pos").between(low + 1, high))
    units = rows.where(F.col("last") | (F.col("pos") == high)).groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.min(F.when(F.col("last"), F.col("conv_id"))).alias("ends"), F.max("pos").alias("depth")
    )
    if deeper is None:
        units = units.withColumns({c: F.lit(None).cast("long") for c in ("n_children", "n_leaves", "saved_tokens")})
    else:
        units = units.join(deeper, ["k1", "k2"], "left")
    begin = turns.where(F.col("pos") == low).select("conv_id", F.struct("k1", "k2").alias("top"))
    units = units.drop("k1", "k2")
    units = units.join(begin, "conv_id") if low else units.withColumn("top", F.struct(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2")))
    units = kept(units)
    path_rows = kept(rows.drop("last").join(units.select("conv_id", "n", F.col("depth").alias("end")), "conv_id"))
    below = path_rows.groupBy("k1", "k2", "pos").agg(
        F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.sum(F.col("end") - F.col("pos")).alias("turns"), F.first("words").alias("words")
    ).where(F.col("turns") > shard_turns)
    top_turns = units.groupBy(F.col("top.k1").alias("k1"), F.col("top.k2").alias("k2")).agg(F.sum(F.col("depth") - low).alias("turns"))
    shared = kept(
        below.withColumnRenamed("pos", "depth").unionByName(
            tops.join(top_turns, ["k1", "k2"]).select("k1", "k2", F.lit(low).cast("long").alias("depth"), F.lit(0).cast("long").alias("n"), "conv_id", "turns", F.lit(0).cast("long").alias("words"))
        )
    )
    inner = shared.where(F.col("depth") > low)
    mark = F.struct("depth", "k1", "k2", "conv_id", "turns").alias("shared")
    on_path = path_rows.select("k1", "k2", F.col("conv_id").alias("unit")).join(inner, ["k1", "k2"]).select("unit", mark).groupBy("unit").agg(F.max("shared").alias("deep"))
    sequences = path_rows.groupBy(F.col("conv_id").alias("unit")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn_key", "words"))).alias("turns"))
    at_top = shared.where(F.col("depth") == low).select(mark.alias("start"), F.struct("k1", "k2").alias("top"))
    dealt = (
        units.withColumnRenamed("conv_id", "unit").join(sequences, "unit").join(on_path, "unit", "left").join(at_top, "top")
        .withColumn("shared", F.coalesce("deep", "start")).withColumn("turns", F.slice("turns", F.col("shared.depth").cast("int") - low + 1, level_turns))
        .withColumn("bucket", F.pmod(F.coalesce(F.xxhash64(F.get("turns", F.lit(0))["turn_key"]), F.lit(0)), F.ceil(F.col("shared.turns") / F.lit(shard_turns))))
        .select(F.col("unit").alias("conv_id"), "n", "ends", "n_children", "n_leaves", "saved_tokens", "turns", "shared", "bucket")
    )
    tasks = min(_MOST_PARTS, parts(turns.sparkSession, path_rows.count(), shard_turns))
    walked, walked_path = table(_walk_shards(dealt, tasks))
    own = walked.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(*(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")), F.min("ends").alias("ends"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_children", "n_leaves", "saved_tokens")}
    merged = kept(shared.drop("turns").join(own, ["k1", "k2"], "left").withColumns(zero).withColumn("saved_tokens", F.col("saved_tokens") + (F.greatest("n", F.lit(1)) - 1) * F.col("words")))
    # each shared node, itself included, with the shared nodes above it: all nodes above a shared one are shared
    lines = merged.where(F.col("depth") > low).select(F.col("conv_id"), F.col("depth").alias("at"), "n_leaves", "saved_tokens")
    path_keys = path_rows.select("conv_id", "pos", "k1", "k2").unionByName(units.select("conv_id", F.lit(low).cast("long").alias("pos"), "top.k1", "top.k2"))
    sums = (
        lines.join(path_keys, "conv_id").where(F.col("pos") < F.col("at")).groupBy("k1", "k2")
        .agg(F.sum((F.col("pos") == F.col("at") - 1).cast("long")).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    )
    total = merged.join(sums, ["k1", "k2"], "left").withColumns(
        {"n_children": F.col("n_children") + F.coalesce("c", F.lit(0)), "n_leaves": F.col("n_leaves") + F.coalesce("l", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("s", F.lit(0))}
    )
    total = kept(total.drop("c", "l", "s", "words"))
    up = path_keys.select("conv_id", (F.col("pos") + 1).alias("depth"), F.struct("k1", "k2").alias("up"))
    parents = total.select(F.struct("k1", "k2").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    upper = total.where(F.col("depth") > low).join(up, ["conv_id", "depth"]).join(parents, "up").withColumnRenamed("n", "n_convs")
    columns = [c.split()[0] for c in _NODE.split(", ")]
    nodes, _ = table(walked.where("k1 IS NULL").select(*columns).unionByName(upper.select(*columns)))
    starts, starts_path = table(total.where(F.col("depth") == low).select("k1", "k2", "n_children", "n_leaves", "saved_tokens"))
    forget(turns.sparkSession, walked_path, *paths)
    return nodes, starts, starts_path


def trie_nodes(conversations: DataFrame, *, family: int = 20, shard_turns: int = SHARD_TURNS, level_turns: int = LEVEL_TURNS) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations, one row for each, the root included.

    ``conv_id`` is the smallest member, ``depth`` the number of turns, ``parent_conv_id`` the parent's ``conv_id`` (null at the root),
    ``n_convs`` the members, ``n_children`` the children, ``n_leaves`` the childless nodes of the subtree, ``saved_tokens`` the sum over
    the subtree of (members - 1) times the words of a node's last turn, ``ends_sha256`` the digest of the members that end there.
    Cases as in ``rebuilt``: null roles and texts are empty, rows without ``conv_id`` take no part, ties of ``turn`` go by the
    turn's digest, repeated rows are repeated turns, conversations may have any number of turns, other columns are not
    read. An empty table has no node, not even a root, as a root without members has no ``conv_id``.
    """
    spark = conversations.sparkSession
    rows, ids, rows_path = rebuilt(conversations, family=family)
    in_order = Window.partitionBy("conv_id").orderBy("pos")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns, turns_path = table(
        rows.withColumns({
            "k1": F.bit_xor(F.xxhash64("pos", "turn_key")).over(so_far), "k2": F.bit_xor(F.xxhash64("turn_key", "pos", F.lit(13))).over(so_far),
            "last": F.lead("pos").over(in_order).isNull(),
        })
    )
    most = turns.agg(F.max("pos").alias("n")).first()["n"] or 0
    convs = ids.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first")).first()
    zero = F.lit(0).cast("long")
    silent = ids.join(turns.where("last").select("conv_id"), "conv_id", "left_anti").select(zero.alias("k1"), zero.alias("k2"), "conv_id")
    first_silent = silent.agg(F.min("conv_id").alias("first")).first()["first"]
    ends, _ = table(_ends(turns.where("last").select("k1", "k2", "conv_id").unionByName(silent), convs["n"]))
    nodes, deeper, deeper_path = [], None, None
    for low in range((max(0, most - 1) // level_turns) * level_turns if most else -1, -1, -level_turns):
        if low:
            tops = turns.where(F.col("pos") == low).groupBy("k1", "k2").agg(F.min("conv_id").alias("conv_id"))
        else:
            tops = spark.createDataFrame([(0, 0, convs["first"])], "k1 long, k2 long, conv_id long")
        found, starts, starts_path = _level(turns, tops, low, level_turns, shard_turns, deeper)
        if deeper_path:
            forget(spark, deeper_path)
        nodes.append(found)
        deeper, deeper_path = starts, starts_path
    top = deeper.first() if deeper is not None else None
    forget(spark, rows_path, turns_path, *([deeper_path] if deeper_path else []))
    root = (convs["first"], 0, None, convs["n"], top["n_children"] if top else 0, top["n_leaves"] if top else 1, top["saved_tokens"] if top else 0, first_silent)
    every = spark.createDataFrame([root] if convs["n"] else [], _NODE)
    for more in nodes:
        every = every.unionByName(more)
    nothing = hashlib.sha256(b"").hexdigest()
    return every.join(ends, "ends", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing))).drop("ends")
