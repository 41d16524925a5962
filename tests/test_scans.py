"""Running values and thinning, split within a key, against plain folds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from proctrace.operators import frames, tasks
from proctrace.operators.scans import ONE_TASK, Measure, counted, running

T0 = dt.datetime(2024, 1, 1)
FRAME = "client_id string, frame_id long, ts timestamp, pipeline_ok boolean, bent boolean"
COMMAND = "client_id string, ts timestamp, cmd_id long, command string, task_id long, actor_id long"


@pytest.fixture(params=["split", "whole"])
def either(spark, request):
    """Each test runs with keys split into hours, and with one window for a key."""
    spark.conf.set(ONE_TASK[0], "0" if request.param == "split" else str(1 << 70))
    yield request.param
    spark.conf.unset(ONE_TASK[0])


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_measures_against_a_fold(spark, either):
    """Nulls in keys, times and values, ties of time, marks in some hours and none in others."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, at(rng.randrange(30) * 1200) if rng.random() < 0.95 else None, rng.choice([None, 1, 2, 5]), rng.random() < 0.1) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, ts timestamp, v long, m boolean")
    v = F.col("v")
    measures = {"total": Measure("sum", v), "past": Measure("last", v), "low": Measure("least", v), "every": Measure("whole", v), "recent": Measure("since", F.when(F.col("m"), 0).otherwise(F.coalesce(v, F.lit(0))))}
    got = {r["i"]: tuple(r)[5:] for r in running(df, ["k"], ("ts", "i"), measures, mark=F.col("m")).collect()}
    expected = {}
    for key in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2] is not None, r[2] or T0, r[1]))
        total, past, low, recent = 0, None, None, 0
        for _, i, _, x, m in own:
            total, past = total + (x or 0), past if x is None else x
            low = min(y for y in (low, x) if y is not None) if (low, x) != (None, None) else None
            recent = 0 if m else recent + (x or 0)
            expected[i] = (total, past, low, sum(r[3] or 0 for r in own), recent)
    assert got == expected


def test_one_client_with_half_of_all_frames(spark, either):
    """Tasks, numbers and counters of a camera whose frames are many hours, against a fold."""
    rng = random.Random(2)
    events = sorted([(rng.choice(["hot"] * 6 + [f"c{i}" for i in range(6)]), rng.randrange(40 * 3600), i) for i in range(3000)], key=lambda e: e[1:])
    rows, log, expected, now = [], [], {}, {}
    for client, s, i in events:
        state = now.setdefault(client, [None, 0, 0, 0, 0])
        if i % 40 == 0:
            kind = "terminate" if state[0] is not None and rng.random() < 0.5 else "initialize"
            task = i if kind == "initialize" else state[0]
            log.append((client, at(s + i / 1e4), i, kind, task, 1))
            state[0], state[1], state[2] = (task if kind == "initialize" else None), 0, 0
            continue
        ok, bent = rng.random() < 0.9, rng.random() < 0.3
        rows.append((client, i, at(s + i / 1e4), ok, bent))
        state[3] += 1
        state[1], state[2], state[4] = state[1] + ok, state[2] + (ok and bent), state[4] + ok
        counts = (None, None) if not ok else (0, 0) if state[0] is None else (state[1] - 1 + state[2], state[1] + state[2])
        expected[i] = (state[0], state[3], state[4] if ok else None, *counts)
    fs, commands = spark.createDataFrame(rows, FRAME), spark.createDataFrame(log, COMMAND)
    good = tasks.accepted_commands(commands)
    both = frames.attach_task(fs, good, numbers=True, bending=True)
    assert {r["frame_id"]: (r["task_id"], r["raw_no"], r["ok_no"], r["stored_count"], r["after_count"]) for r in both.collect()} == expected
    by_task = frames.running_bending(frames.attach_task(fs, good), failed=True)
    assert {r["frame_id"]: (r["stored_count"], r["after_count"]) for r in by_task.collect()} == {i: x[3:] for i, x in expected.items()}


def test_split_plans_have_no_window_of_a_whole_key(spark):
    """All windows over rows are by key and hour; those by key alone are over totals of hours."""
    spark.conf.set(ONE_TASK[0], "0")
    try:
        rows = spark.range(1000).select(F.lit("c").alias("k"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("i"))
        plan = running(rows, ["k"], ("ts", "i"), {"n": Measure("sum", counted())})._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert len(windows) == 2 and sum("__hour" in w and "__turn_" in w for w in windows) == 1 and sum("__total_n" in w for w in windows) == 1
    finally:
        spark.conf.unset(ONE_TASK[0])


@pytest.mark.parametrize(("steps", "fan"), [(1, 2), (3, 2), (4, 3), (16, 64)])
def test_throttle_split_within_a_camera(spark, steps, fan):
    """Buckets, groups and chains small enough to occur many times; ties, gaps, late starts and bad rows."""
    rng = random.Random(steps)
    rows, expected = [], []
    for client, rate in (("even", 0.5), ("odd", 1.5), ("sparse", 60), ("dense", 0.05)):
        t, last = rng.random() * 50, None
        for i in range(400):
            gap = rate * (1 if client == "even" else rng.choice([0, 0.3, 1, 1.7, 2])) + (500 if rng.random() < 0.01 else 0)
            t += gap
            key = len(rows)
            rows.append((client, key, at(round(t, 6)), True, False))
            ms = rows[-1][2]
            if last is None or (ms - last).total_seconds() >= 2:
                last = ms
                expected.append(key)
    rows += [rows[0], (None, -1, at(1), True, False), ("even", -2, None, True, False)]
    df = spark.createDataFrame(rows, FRAME).repartition(3)
    expected = sorted([*expected, -1, -2])
    spark.conf.set(ONE_TASK[0], "0")
    try:
        split = frames.throttle(df, 2.0, steps=steps, fan=fan)
        assert sorted(r["frame_id"] for r in split.collect()) == expected
        assert "Python" not in split._jdf.queryExecution().executedPlan().toString()
        spark.conf.set(ONE_TASK[0], str(1 << 70))
        assert sorted(r["frame_id"] for r in frames.throttle(df, 2.0).collect()) == expected
    finally:
        spark.conf.unset(ONE_TASK[0])
