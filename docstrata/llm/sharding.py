"""K-d tree sharding by bytes.

Documents with one text are one unit (a unit that no shard can hold is cut into pieces by id). The units of a node are
split at the weighted median of the metadata dimension that is widest in the node, until leaves reach the target bytes.
A unit so heavy that the median falls inside it is set aside on one side, and the median of the others makes up for it.
Medians come from histograms that the cluster counts; only bin sums reach the driver, and one row for each node of the tree.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.shared import forget, table

_BINS = 4096  # of a node, and less where many nodes are open
_ALL_BINS = 1 << 18  # of all open nodes
_PIECES = 64  # pieces of a shard's size, for a unit that no shard can hold
_BROADCAST_VALUES = 200_000  # distinct values of a text dimension; more are joined by a shuffle
_TIE = "tie"
_LAST = 2**63 - 1


def _whole(df: DataFrame, name: str) -> Column | None:
    """A number column in whole units, nulls as the lowest; None for other types."""
    kind = df.schema[name].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        return None
    return F.coalesce(F.floor(F.col(name)).try_cast("long"), F.lit(0))


def _ordinals(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Each distinct value (as a string, null as empty) with a number that keeps their order: sorted by range, no window."""
    values = df.select(F.coalesce(F.col(name).cast("string"), F.lit("")).alias("value")).distinct()
    return table(values.orderBy("value").select("value", F.monotonically_increasing_id().alias("ordinal")))


def _pick(dims: list[str]) -> Column:
    """The value of the dimension that the column ``dim`` names."""
    return functools.reduce(lambda acc, c: F.when(F.col("dim") == c, F.col(c)).otherwise(acc), dims, F.lit(None).cast("long"))


def _medians(units: DataFrame, nodes: dict[int, dict], allowed: float) -> tuple[dict[int, tuple[str, int, int]], list[tuple[int, int, int, bool]]]:
    """For each node the cut (dimension, value, tie): units up to (value, tie) go left. Rounds of ever finer bins.

    Also the units set aside, as (node, key, piece, right): the median falls inside them, and no cut comes nearer to it
    than ``allowed`` bytes.
    """
    spark = units.sparkSession
    open_ = {
        k: {"dim": v["dim"], "ends": (v["low"], v["high"]), "low": v["low"], "high": v["high"], "value": None, "before": 0, "goal": v["bytes"] / 2, "room": v["bytes"] / 2, "slack": v["bytes"] * 2e-4}
        for k, v in nodes.items()
    }
    cuts: dict[int, tuple[str, int, int]] = {}
    aside: list[tuple[int, int, int, bool]] = []
    axes = [c for c in units.columns if c.startswith("axis_")]
    while open_:
        most, rows = max(8, min(_BINS, _ALL_BINS // len(open_))), []
        for k, s in open_.items():
            s["width"] = max(1, -(-(s["high"] - s["low"] + 1) // most))
            rows.append((k, s["dim"], s["value"], s["low"], s["high"], s["width"]))
        plan = spark.createDataFrame(rows, "node long, dim string, value long, low long, high long, width long")
        # the plan has a row for each open node, at most one for each leaf of the tree
        joined = units.join(F.broadcast(plan), "node")
        if aside:
            joined = joined.join(F.broadcast(spark.createDataFrame([x[:3] for x in aside], "node long, key long, piece int")), ["node", "key", "piece"], "left_anti")
        axis = _pick(axes)
        seen = F.when(F.col("value").isNull(), axis).otherwise(F.col(_TIE))
        inside = (F.col("value").isNull() | (axis == F.col("value"))) & seen.between(F.col("low"), F.col("high"))
        bins = (
            joined.where(inside).withColumn("seen", seen).groupBy("node", F.expr("(seen - low) div width").alias("bin"))
            .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("units"), F.min("key").alias("key"), F.min("piece").alias("piece")).collect()
        )
        found: dict[int, list] = {}
        for r in sorted(bins, key=lambda r: (r["node"], r["bin"])):
            found.setdefault(r["node"], []).append(r)
        for k, s in list(open_.items()):
            if k not in found:  # all its units are set aside
                cuts[k] = (s["dim"], s["high"], _LAST)
                del open_[k]
                continue
            total = s["before"]
            for r in found[k]:
                if total + r["bytes"] >= s["goal"] or r is found[k][-1]:
                    break
                total += r["bytes"]
            low_edge = s["low"] + r["bin"] * s["width"]
            high_edge = min(low_edge + s["width"] - 1, s["high"])
            left, right = s["goal"] - total, total + r["bytes"] - s["goal"]
            near = min(abs(left), abs(right))
            if r["units"] == 1 and near > max(allowed, s["slack"]) and right > 0:
                to_right = r["bytes"] <= s["room"]
                aside.append((k, r["key"], r["piece"], to_right))
                s["room"] -= r["bytes"] if to_right else 0
                s["goal"] -= 0 if to_right else r["bytes"]
                s |= {"low": s["ends"][0], "high": s["ends"][1], "value": None, "before": 0}
            elif near <= s["slack"] or r["units"] == 1:
                edge = high_edge if abs(right) <= abs(left) else low_edge - 1
                cuts[k] = (s["dim"], edge, _LAST) if s["value"] is None else (s["dim"], s["value"], edge)
                del open_[k]
            elif s["width"] == 1 and s["value"] is None:
                s |= {"value": low_edge, "low": 0, "high": _LAST, "before": total}
            elif s["width"] == 1:  # units that tie in everything
                cuts[k] = (s["dim"], s["value"], high_edge if abs(right) <= abs(left) else low_edge - 1)
                del open_[k]
            else:
                s |= {"low": low_edge, "high": high_edge, "before": total}
    return cuts, aside


def kd_shards(
    docs: DataFrame, *, target_bytes: int | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text",
    dimensions: tuple[str, ...] = ("n_chars", "source", "lang"), slot_rows: int = 2000,
) -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes + 1), ``text_crc32``, ``shard``, ``slot`` of each row.

    The depth follows from ``target_bytes`` (leaves of at most about that size) or from ``shards`` (a power of two).
    Equal texts share a shard, unless their copies together hold more than a whole shard's share of the bytes: only such
    a group is cut, by id, into pieces of a 64th of that share. Shard sizes differ by little more than the largest
    document, or by a hundredth of a shard's share. Slots count from 0 without gaps, by id.

    Null texts count as empty ones (size 1) and share their group; null dimensions count as the lowest value; null and
    repeated ids are rows like others (of a group that is cut, rows without an id are dealt out one by one); dimensions
    that the table lacks are left out; an empty table gives an empty result; other columns are not read, so their names
    do not matter.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    named = [c for c in dimensions if c in docs.columns]
    wide = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.monotonically_increasing_id()), F.lit(7)).alias("own"),
        *((F.coalesce(F.col(c).cast("string"), F.lit("")) if _whole(docs, c) is None else _whole(docs, c)).alias(f"axis_{c}") for c in named),
    )
    lists = []
    for c in named:
        if _whole(docs, c) is None:
            values, path = _ordinals(docs, c)
            lists.append(path)
            values = F.broadcast(values) if values.count() <= _BROADCAST_VALUES else values
            wide = wide.join(values.withColumnsRenamed({"value": f"axis_{c}", "ordinal": "ordinal"}), f"axis_{c}").drop(f"axis_{c}").withColumnRenamed("ordinal", f"axis_{c}")
    base, base_path = table(wide.withColumn("axis_size", F.col("size")))
    dims = [*(f"axis_{c}" for c in named), "axis_size"]
    total, largest = (x or 0 for x in base.agg(F.sum("size"), F.max("size")).first())
    if shards is None:
        shards = 2 ** max(0, math.ceil(math.log2(max(1, total / (target_bytes or total or 1)))))
    depth = max(0, shards - 1).bit_length()

    # at most as many groups as shards can each hold more than a shard's share
    share = max(total / max(1, shards), 1)
    heavy = base.groupBy("key").agg(F.sum("size").alias("held")).where(F.col("held") > max(share, largest)).select("key", F.ceil(F.col("held") * _PIECES / F.lit(float(share))).alias("cut"))
    piece = F.when(F.col("cut").isNull(), F.lit(0)).otherwise(F.pmod(F.col("own"), F.col("cut"))).cast("int")
    rows = base.join(F.broadcast(heavy), "key", "left").withColumn("piece", piece).drop("cut", "own")
    units, path = table(
        rows.groupBy("key", "piece").agg(F.sum("size").alias("bytes"), *(F.min(c).alias(c) for c in dims))
        .withColumn(_TIE, F.shiftrightunsigned(F.xxhash64("key", "piece"), 1)).withColumn("node", F.lit(0).cast("long"))
    )
    ends = [f(c).alias(f"{c}{s}") for c in dims for f, s in ((F.min, "_lo"), (F.max, "_hi"))]
    span = None
    for _ in range(depth):
        stats = units.groupBy("node").agg(F.sum("bytes").alias("bytes"), *ends).collect()
        span = span or (stats[0] if stats else None)
        nodes = {}
        for r in stats:
            widest = max(dims, key=lambda c: ((r[f"{c}_hi"] - r[f"{c}_lo"]) / max(1, span[f"{c}_hi"] - span[f"{c}_lo"]), c))  # noqa: B023
            nodes[r["node"]] = {"dim": widest, "low": r[f"{widest}_lo"], "high": r[f"{widest}_hi"], "bytes": r["bytes"]}
        cuts, aside = _medians(units, nodes, max(largest, share / 128))
        plan = spark.createDataFrame([(k, *v) for k, v in cuts.items()], "node long, dim string, cut long, cut_tie long")
        axis = _pick(dims)
        right = (axis > F.col("cut")) | ((axis == F.col("cut")) & (F.col(_TIE) > F.col("cut_tie")))
        placed = units.join(F.broadcast(plan), "node")
        if aside:  # a row for each unit in which a median fell
            placed = placed.join(F.broadcast(spark.createDataFrame(aside, "node long, key long, piece int, side boolean")), ["node", "key", "piece"], "left")
            right = F.coalesce("side", right)
        moved = placed.withColumn("node", F.col("node") * 2 + right.cast("long")).select(*units.columns)
        old, (units, path) = path, table(moved)
        forget(spark, old)

    placed = rows.join(units.select("key", "piece", F.col("node").cast("int").alias("shard")), ["key", "piece"]).select("doc_id", "size", "text_crc32", "shard")
    placed, _ = table(placed)
    out = number_slots(placed, max(1, placed.count() // max(1, slot_rows * shards)))
    forget(spark, base_path, path, *lists)
    return out


def number_slots(placed: DataFrame, strips: int) -> DataFrame:
    """``placed`` with ``slot``: 0, 1, ... in each ``shard``. Rows are numbered in strips by id, then strips are offset."""
    cut = placed.withColumn("strip", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(strips)).cast("int"))
    starts = cut.groupBy("shard", "strip").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "start", F.sum("n").over(Window.partitionBy("shard").orderBy("strip")) - F.col("n")
    )
    own = F.row_number().over(Window.partitionBy("shard", "strip").orderBy("doc_id", "text_crc32", "size"))
    return cut.withColumn("own", own).join(starts.drop("n"), ["shard", "strip"]).withColumn("slot", (F.col("start") + F.col("own") - 1).cast("long")).drop("strip", "own", "start")
