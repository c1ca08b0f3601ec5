"""Deadlines by timers: finished jobs go after 300 seconds, plans expire after 30 minutes, runs are stale after 4 hours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed: seconds until something that was opened expires, by its kind.
LIMITS = {"job": 300, "plan": 1_800, "run": 14_400}
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_COLUMNS = ["key", "at_ms", "opens", "kind"]


def _packed(rows: pd.DataFrame) -> tuple[bytes]:
    """Rows as one value of the state; those of a key stand together, which packs best."""
    rows = rows.sort_values(["key", "at_ms"])
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(rows[c], t, from_pandas=True) for c, t in zip(_COLUMNS, (pa.string(), pa.int64(), pa.bool_(), pa.string()))], _COLUMNS)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(value: tuple) -> pd.DataFrame:
    return pa.ipc.open_stream(value[0]).read_pandas()


def _settled(rows: pd.DataFrame, until: int) -> tuple[pd.DataFrame, pd.DataFrame, int | None]:
    """What expires up to ``until`` of rows (``_COLUMNS``), the rows that are still needed, and when the next of them is due.

    A row that opened something still open is needed until its deadline: with the rows that follow it gives the same again.
    """
    rows = rows.assign(code=pd.factorize(rows["key"], use_na_sentinel=False)[0], limit=rows["kind"].map(LIMITS))
    if rows.loc[rows["opens"], "limit"].isna().any():
        raise KeyError(f"kinds are {', '.join(LIMITS)}")
    rows = rows.sort_values(["code", "at_ms", "opens", "limit"], ascending=[True, True, False, True], kind="stable", ignore_index=True)
    at, opens, code = rows["at_ms"].to_numpy(), rows["opens"].to_numpy(bool), rows["code"].to_numpy()
    deadline = at + rows["limit"].fillna(0).to_numpy("int64") * 1000
    passed = at <= until
    followed = np.append((code[1:] == code[:-1]) & passed[1:], False)  # by a row of the same key that has passed too
    ended = followed & (np.append(at[1:], 0) <= deadline)
    expires = passed & opens & ~ended & (followed | (deadline <= until))
    needed = ~passed | (opens & ~followed & (deadline > until))
    due = np.where(passed, deadline, at)[needed]
    return pd.DataFrame({"key": rows["key"], "kind": rows["kind"], "expired_ms": deadline})[expires], rows.loc[needed, _COLUMNS], int(due.min()) if len(due) else None


class _Deadlines(StatefulProcessor):
    """Of a shard of keys: rows that the watermark has not passed, those that opened what is still open, and one timer for the next that is due.

    Rows are kept packed, those of a batch in a value or a few, so that the state is asked a few times for a shard and batch and not for each row.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.due = handle.getValueState("due", "at long")

    def _wake(self, at: int) -> None:
        """The timer goes off at ``at``, or before if it was to."""
        before = self.due.get() if self.due.exists() else None
        if before is not None and before[0] <= at:
            return
        if before is not None:
            self.handle.deleteTimer(before[0])
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            self.waiting.appendValue(_packed(part))
            least = int(part["at_ms"].min())  # by then all rows before it are there
            first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = pd.concat(map(_unpacked, self.waiting.get()), ignore_index=True)
        expired, needed, due = _settled(rows, timerValues.getCurrentWatermarkInMs())
        self.due.clear()  # the timer that went off is gone
        if due is None:
            self.waiting.clear()
        else:
            self.waiting.put([_packed(needed)])
            self._wake(due)
        if len(expired):
            yield expired

    def close(self) -> None:
        pass


def expiries(rows: DataFrame, delay: str = "2 hours", *, shards: int = 256) -> DataFrame:
    """``key``, ``kind`` and ``expired_at`` of what stayed open for its kind's limit, emitted once the watermark reaches that time.

    ``rows`` is a stream of ``key``, ``kind`` (of ``LIMITS``), ``opens`` and ``at`` (timestamp; rows without one are left out). A row that opens sets the key's deadline, and
    replaces one that has not passed; any other row ends it. A row at the deadline itself still counts; of rows of one time
    those that open come first. Rows may come in any order within the watermark's ``delay``: each waits until the watermark
    reaches it, and is then taken in order of time. Keys are dealt to ``shards`` by hash, and a shard holds the waiting rows and open deadlines
    of its keys in one state with one timer; both are cleared when done. A task holds one shard's rows at a time, so there
    should be as many shards as leave some 20,000 waiting rows to each; a stream that goes on from a checkpoint must keep
    their number. A key may be of any type that a cast to string and back keeps. Needs the RocksDB state store (``with_rocks``).
    """
    kind = rows.schema["key"].dataType.simpleString()
    slim = rows.where("at is not null").select(
        F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), F.col("key").cast("string").alias("key"), F.unix_millis("at").alias("at_ms"), F.coalesce("opens", F.lit(False)).alias("opens"), "kind", "at",
    )
    out = slim.withWatermark("at", delay).groupBy("shard").transformWithStateInPandas(
        statefulProcessor=_Deadlines(), outputStructType="key string, kind string, expired_ms long", outputMode="Append", timeMode="EventTime"
    )
    return out.select(F.col("key").cast(kind).alias("key"), "kind", F.timestamp_millis("expired_ms").alias("expired_at"))


def expiries_batch(rows: DataFrame) -> DataFrame:
    """The same of a table, with all rows taken as there: times count in milliseconds, and what has no further row expires at its deadline."""
    limit = F.coalesce(*(F.when(F.col("kind") == k, F.lit(s)) for k, s in LIMITS.items()))
    order = Window.partitionBy("key").orderBy(F.unix_millis("at"), F.desc("opens"))
    seen = rows.withColumns({"following": F.lead(F.unix_millis("at")).over(order), "expired_ms": F.unix_millis("at") + limit * 1000})
    return seen.where("opens AND (following IS NULL OR following > expired_ms)").select("key", "kind", F.timestamp_millis("expired_ms").alias("expired_at"))


class with_rocks:
    """The session's state store is RocksDB inside, and what it was before afterwards."""

    def __init__(self, spark):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(_PROVIDER, None)
        self.conf.set(_PROVIDER, _ROCKS)

    def __exit__(self, *_):
        if self.before is None:
            self.conf.unset(_PROVIDER)
        else:
            self.conf.set(_PROVIDER, self.before)
