"""Streams that wait for one another and for the clock: equal to batch forms, also over a restart."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docstrata.streaming import expiry, flows

T0 = datetime.datetime(2024, 1, 1)


def minutes(m):
    return T0 + datetime.timedelta(minutes=m)


def as_files(spark, rows, schema, folder, numbers):
    """Writes rows in files ``numbers``, one batch of the stream each."""
    for n, part in zip(numbers, (rows[i :: len(numbers)] for i in range(len(numbers)))):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/n={n}")


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_grades_join_the_query_log_over_a_restart(spark, tmp_path):
    r = random.Random(1)
    asked_schema, graded_schema = "key long, query_id long, asked_at timestamp", "key long, grade_id long, grade double, graded_at timestamp"
    asked = [(i % 7, i, minutes(i)) for i in range(400)]
    graded = [(r.randint(0, 8), i, r.random(), minutes(i + r.randint(-20, 20))) for i in range(0, 400, 2)]
    name, out = "grades", None
    for half in (0, 1):
        for rows, schema, kind in ((asked, asked_schema, "asked"), (graded, graded_schema, "graded")):
            as_files(spark, rows[200 * half : 200 * half + 200] if kind == "asked" else rows[100 * half : 100 * half + 100], schema, f"{tmp_path}/{kind}", [2 * half, 2 * half + 1])
        joined = flows.graded_queries(stream(spark, asked_schema, f"{tmp_path}/asked"), stream(spark, graded_schema, f"{tmp_path}/graded"), "30 minutes", "1 hour")
        out = flows.drained(spark, joined, f"{tmp_path}", name=name)  # the second time from where the first ended
    a, g = spark.createDataFrame(asked, asked_schema), spark.createDataFrame(graded, graded_schema).withColumnRenamed("key", "k")
    meets = (F.col("key") == F.col("k")) & (F.col("graded_at") >= F.col("asked_at")) & (F.col("graded_at") <= F.col("asked_at") + F.expr("interval 30 minutes"))
    settled = F.lit(minutes(400 - 60 - 60))
    want = a.join(g, meets, "left").where(F.col("asked_at") < settled)
    rows = lambda df: sorted((x["query_id"], x["grade_id"] if x["grade_id"] is not None else -1) for x in df.collect())
    got = rows(out.where(F.col("asked_at") < settled))
    assert got == rows(want) and any(i == -1 for _, i in got) and any(i >= 0 for _, i in got)


def test_timers_tell_what_expires_over_a_restart(spark, tmp_path):
    r = random.Random(2)
    schema = "key long, kind string, opens boolean, at timestamp"
    times = r.sample(range(4_000), 900)
    rows = [(r.randint(0, 30), r.choice(["job", "plan", "run"]), r.random() < 0.6, T0 + datetime.timedelta(seconds=30 * m)) for m in sorted(times)]
    rows += [(50, "job", True, minutes(10)), (50, "job", False, minutes(15)), (51, "job", True, minutes(10)), (51, "job", False, minutes(10)), (52, "plan", True, minutes(10))]
    rows.sort(key=lambda x: x[3] + datetime.timedelta(minutes=r.randint(0, 100)))  # late, but within the watermark
    for half in (0, 1):
        part = rows[len(rows) // 2 * half :] if half else rows[: len(rows) // 2]
        for i in range(3):
            as_files(spark, part[len(part) // 3 * i : None if i == 2 else len(part) // 3 * (i + 1)], schema, f"{tmp_path}/rows", [3 * half + i])
        with expiry.with_rocks(spark):
            out = flows.drained(spark, expiry.expiries(stream(spark, schema, f"{tmp_path}/rows"), "2 hours"), f"{tmp_path}", name="expiry")
    settled = F.lit(minutes(2_000 - 125))
    found = lambda df: sorted((x["key"], x["kind"], x["expired_at"]) for x in df.where(F.col("expired_at") < settled).collect())
    want = found(expiry.expiries_batch(spark.createDataFrame(rows, schema)))
    got = found(out)
    assert got == want and len(got) > 50
    assert [x[0] for x in got if x[0] >= 50] == [52]  # the job of 50 ended at its deadline, that of 51 at once


def test_late_beyond_the_watermark_is_not_waited_for(spark, tmp_path):
    schema = "key long, kind string, opens boolean, at timestamp"
    as_files(spark, [(1, "job", True, minutes(0)), (2, "job", True, minutes(900))], schema, f"{tmp_path}/rows", [0])
    with expiry.with_rocks(spark):
        flows.drained(spark, expiry.expiries(stream(spark, schema, f"{tmp_path}/rows"), "1 hour"), f"{tmp_path}", name="late")
        as_files(spark, [(1, "job", False, minutes(1)), (3, "job", True, minutes(2_000))], schema, f"{tmp_path}/rows", [1])
        out = flows.drained(spark, expiry.expiries(stream(spark, schema, f"{tmp_path}/rows"), "1 hour"), f"{tmp_path}", name="late")
    assert sorted((x["key"], x["expired_at"]) for x in out.collect()) == [(1, minutes(5)), (2, minutes(905))]
    with pytest.raises(Exception):
        expiry.expiries(spark.createDataFrame([], "key long"))


def test_a_shard_asks_its_state_a_few_times_for_many_rows():
    calls, timers = [], set()

    class State:
        def __init__(self):
            self.held = None

        def __getattr__(self, name):
            def call(*value):
                calls.append(name)
                if name == "exists":
                    return self.held is not None
                if name == "get":
                    return iter(self.held) if isinstance(self.held, list) else self.held
                self.held = None if name == "clear" else (self.held or []) + [value[0]] if name == "appendValue" else value[0]

            return call

    class Handle:
        def getListState(self, *_):
            return State()

        getValueState = getListState

        def registerTimer(self, at):
            calls.append("timer")
            timers.add(at)

        def deleteTimer(self, at):
            calls.append("no timer")
            timers.discard(at)

    class Now:
        def getCurrentWatermarkInMs(self):
            return until

    r, n = random.Random(3), 20
    rows = [(r.choice([None, "", *map(str, range(60))]), r.randint(0, 200) * 100_000, r.random() < 0.6, r.choice(["job", "plan", "run"])) for _ in range(4_000)]
    rows = list({(k, at): (k, at, opens, kind) for k, at, opens, kind in rows}.values())  # no two rows of one key and time
    processor, found = expiry._Deadlines(), []
    processor.init(Handle())
    for i in range(n):
        low, high, until = 1_000_000 * i, 1_000_000 * (i + 1), 1_000_000 * i + 350_000 if i < n - 1 else 10**9
        part = [x for x in rows if low <= x[1] < high or i == n - 1 and x[1] >= high]
        r.shuffle(part)
        processor.handleInputRows((0,), iter([pd.DataFrame(part, columns=["key", "at_ms", "opens", "kind"])]), Now())
        for due in sorted(t for t in timers if t <= until):
            timers.discard(due)
            for out in processor.handleExpiredTimer((0,), Now(), due):
                assert (out["expired_ms"] <= until).all()
                found += list(out.itertuples(index=False, name=None))
    want = []
    for key in {x[0] for x in rows}:
        own = sorted((at, opens, kind) for k, at, opens, kind in rows if k == key)
        for (at, opens, kind), after in zip(own, [*own[1:], (10**12, False, "")]):
            deadline = at + expiry.LIMITS[kind] * 1000
            want += [(key, kind, deadline)] if opens and after[0] > deadline else []
    by = lambda x: (str(x[0]), x[2])
    assert sorted(((None if pd.isna(k) else k, kind, at) for k, kind, at in found), key=by) == sorted(want, key=by) and len(want) > 100
    assert len(calls) < 20 * n and not timers
