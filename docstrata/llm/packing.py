"""Best-fit packing into sequences of several permitted lengths.

Pieces are packed longest first. A piece goes to the open bin it leaves fullest; if none has room, the bin size is
opened whose cost is least for what the remaining pieces would put into it. In the end each bin shrinks to the smallest
permitted length that holds its contents. Documents are counted in tokens of a byte-level model (their UTF-8 bytes)
unless a length is given; token ids themselves are packed into sequences by ``sequences``.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.shared import parts, table

CAPACITIES = (2048, 4096, 8192, 16_384, 32_768)


def cost(capacity: int, fixed: float = 64.0, quadratic: float = 1 / 32768) -> float:
    """Cost of a sequence: its slots, a fixed part, and attention's quadratic part."""
    return fixed + capacity + quadratic * capacity * capacity


class _Lengths:
    """A multiset of lengths that finds the largest one not above a bound."""

    def __init__(self, lengths):
        self.count: dict[int, int] = {}
        for x in lengths:
            self.count[x] = self.count.get(x, 0) + 1
        self.sorted = sorted(self.count)

    def take(self, x: int):
        self.count[x] -= 1
        if not self.count[x]:
            del self.count[x]
            self.sorted.pop(bisect.bisect_left(self.sorted, x))

    def fill(self, room: int) -> int:
        """How much of ``room`` the lengths would take up, largest first (each used as often as it is there)."""
        used, at = 0, bisect.bisect_right(self.sorted, room) - 1
        while at >= 0 and room > 0:
            x = self.sorted[at]
            n = min(self.count[x], room // x)
            used, room = used + n * x, room - n * x
            at = min(at, bisect.bisect_right(self.sorted, room)) - 1
        return used


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of each length, and the final capacity of each bin. No length may exceed the largest capacity."""
    sizes = sorted(capacities)
    left = _Lengths(lengths)
    room_of: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted
    used: list[int] = []
    place: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        x = lengths[i]
        left.take(x)
        at = bisect.bisect_left(rooms, x)
        if at < len(rooms):
            room = rooms[at]
            b = room_of[room].pop()
            if not room_of[room]:
                del room_of[room]
                rooms.pop(at)
        else:
            room = min((c for c in sizes if c >= x), key=lambda c: (cost(c) / (x + left.fill(c - x)), c))
            b = len(used)
            used.append(0)
        place[i] = (b, used[b])
        used[b] += x
        room -= x
        if room:
            if room not in room_of:
                room_of[room] = []
                bisect.insort(rooms, room)
            room_of[room].append(b)
    return place, [sizes[bisect.bisect_left(sizes, u)] for u in used]


def byte_tokens(text: Column) -> Column:
    """Length of a text in UTF-8 bytes, and one for the separator after it; null texts have only that."""
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + 1


def _packed(cut: DataFrame, capacities: tuple[int, ...], shard_rows: int) -> DataFrame:
    """``cut`` (row, piece, start, length and other columns, a stored table) with ``bin_id``, ``capacity`` and ``offset``.

    Pieces are dealt to shards of about ``shard_rows`` by a hash of their row; each shard is packed by itself, longest
    first, so a bin's id is its shard and its number there.
    """
    shards = parts(cut.sparkSession, cut.count(), shard_rows)
    names = cut.columns

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "row", "piece"], ascending=[False, True, True], kind="stable")
        place, capacity = pack(frame["length"].tolist(), capacities)
        bins = [b for b, _ in place]
        return frame[names].assign(bin_id=[(key[0] << 32) + b for b in bins], capacity=[capacity[b] for b in bins], offset=[o for _, o in place])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("row", "piece", F.lit(3)), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, f"{kinds}, bin_id long, capacity int, offset int")


def best_fit(docs: DataFrame, *, id_col: str = "doc_id", length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, shard_rows: int = 20_000) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``bin_id``, ``capacity``, ``offset`` for each piece of each row.

    A document longer than the largest capacity becomes pieces of that capacity and a rest. ``length`` counts what is
    packed of a row, at least 1 (``byte_tokens`` of the text if it is not given).

    Null and empty texts have length 1 (the separator); null ids and repeated rows are packed like others, each row by
    itself; ties in length are ordered by where a row stood in its input; an empty table gives an empty result; other
    columns are not read.
    """
    most = max(capacities)
    count = F.greatest(F.coalesce((byte_tokens(F.col("text")) if length is None else length).cast("long"), F.lit(1)), F.lit(1))
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), count.alias("n")).withColumn("row", F.monotonically_increasing_id())
    cut, _ = table(
        sized.select("row", "doc_id", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / most).cast("int"))).alias("piece"))
        .select("row", "doc_id", "piece", (F.col("piece").cast("long") * most).alias("start"), F.least(F.col("n") - F.col("piece").cast("long") * most, F.lit(most)).cast("int").alias("length"))
    )
    return _packed(cut, capacities, shard_rows).drop("row")


def sequences(
    coded: DataFrame, *, separator: int, id_col: str = "doc_id", ids_col: str = "ids", capacities: tuple[int, ...] = (512, 1024, 2048, 4096, 8192), shard_rows: int = 20_000,
) -> DataFrame:
    """Packed training sequences of token ids, such as ``bpe.encode`` gives: one row for each bin.

    Returns ``bin_id``, ``capacity``, ``ids`` (the contents of the bin, each document followed by ``separator``, and
    separators up to the capacity), ``doc_ids`` and ``starts`` (whose piece begins where). A bin holds at most the largest
    capacity, so no row grows with the table. Null ids arrays count as empty ones; other cases as in ``best_fit``.
    """
    most = max(capacities)
    whole = F.concat(F.coalesce(F.col(ids_col).cast("array<int>"), F.lit([]).cast("array<int>")), F.array(F.lit(separator)))
    rows = coded.select(F.col(id_col).cast("long").alias("doc_id"), whole.alias("all")).withColumn("row", F.monotonically_increasing_id())
    at = F.sequence(F.lit(0), ((F.size("all") - 1) / most).cast("int"))
    cut, _ = table(
        rows.select("row", "doc_id", "all", F.explode(at).alias("piece"))
        .select("row", "doc_id", "piece", (F.col("piece").cast("long") * most).alias("start"), F.slice("all", F.col("piece") * most + 1, F.lit(most)).alias("part"))
        .withColumn("length", F.size("part"))
    )
    placed = _packed(cut.select("row", "piece", "length"), capacities, shard_rows).drop("length")
    pieces = placed.join(cut.select("row", "piece", "doc_id", "part"), ["row", "piece"])
    bins = pieces.groupBy("bin_id", "capacity").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "part"))).alias("p"))
    flat = F.flatten(F.transform("p", lambda x: x["part"]))
    filled = F.concat(flat, F.array_repeat(F.lit(separator), F.col("capacity") - F.size(flat)))
    return bins.select("bin_id", "capacity", filled.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))
