import time
from urllib.parse import unquote

import pandas as pd
import pytest
from pyspark.sql import functions as F

from proctrace.operators import frames as ops
from proctrace.operators import history, tasks
from proctrace.plans import queries as q
from proctrace.sources import driver_tables as src
from proctrace.sources.store import LatestTable, SegmentStore, write_playlists
from proctrace.sources.tables import append_segments, read_frames, read_images, read_keypoints, read_table, write_keypoints
from proctrace.streaming import stateful as st

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def stream(spark, df, path, parts=3, order=("us",)):
    """df as a stream of micro-batches in time order."""
    from pyspark.sql import Window as W

    cut = df.withColumn("part", F.ntile(parts).over(W.orderBy(*order)))
    for p in range(1, parts + 1):
        cut.where(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(df, tmp_path, mode="append"):
    rows = []
    query = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, i: rows.extend(b.collect())).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return [tuple(r) for r in rows]


def rows(spark):
    return q.results(spark, D).select("client_id", "frame_id", F.unix_micros("ts").alias("us"), "pipeline_ok", "task_id", "bent")


def test_stream_throttle_equals_batch(rocks, tmp_path):
    live = stream(rocks, rows(rocks), tmp_path / "in")
    got = drain(st.stateful(live, st.Throttle(q.THROTTLE_S), st.THROTTLE_SCHEMA), tmp_path / "b")
    batch = ops.throttle(src.frames(rocks, D), q.THROTTLE_S).select("client_id", "frame_id", F.unix_micros("ts")).collect()
    assert sorted(got) == sorted(map(tuple, batch))


def test_stream_frames_with_segments_equal_batch(rocks, tmp_path):
    got = drain(st.stateful(stream(rocks, rows(rocks), tmp_path / "in"), st.SegmentFrames(10), st.ASSIGNED_SCHEMA), tmp_path)
    batch = ops.assign_segments(src.frames(rocks, D), 10).select("client_id", "frame_id", "raw_segment", "raw_pos", "ok_segment", "ok_pos").collect()
    assert sorted(got, key=str) == sorted(map(tuple, batch), key=str)


def test_stream_latest_and_eviction(rocks, tmp_path):
    """Results of the newest frames; what a client had before it left doesn't come back."""
    base = rows(rocks).withColumn("result", F.to_json(F.struct("bent"))).withColumn("removed", F.lit(False))
    left = base.groupBy("client_id").agg(F.expr("percentile_disc(0.97) within group (order by us)").alias("us")).where("client_id < 'camera_00005'")
    gone = left.select("client_id", F.lit(1 << 60).alias("frame_id"), "us", F.lit(False).alias("pipeline_ok"), F.lit(True).alias("removed"))
    got = drain(st.stateful(stream(rocks, base.unionByName(gone, allowMissingColumns=True), tmp_path / "in", 2), st.Latest(5), st.LATEST_SCHEMA, mode="update"), tmp_path, "update")
    last: dict = {}
    for client, no, *frame in got:
        last[client] = [*([] if no < 2 else last[client]), *([tuple(frame)] if no else [])]
    after = base.join(left.withColumnRenamed("us", "left_us"), "client_id", "left").where("left_us is null or us > left_us").withColumn("ts", F.col("us"))
    expected: dict = {}
    for r in ops.recent(after, 5).orderBy("client_id", "no").collect():
        expected.setdefault(r["client_id"], []).append((r["frame_id"], r["us"], r["result"]))
    silent = set(last) - set(expected)  # those that left and have no processed frame since
    assert silent < {r["client_id"] for r in left.collect()} and {c: x for c, x in last.items() if c not in silent} == expected
    assert all(last[c] == [] for c in silent)
    assert any(len(x) < 5 for x in expected.values())


def test_stream_status_feed_equals_batch(rocks, tmp_path):
    commands, frames = src.commands(rocks, D), q.results(rocks, D)
    counts = frames.where("pipeline_ok").select("client_id", "ts", "task_id", "after_count")
    ticks = src.frames(rocks, D).select("client_id", "ts")
    none = F.lit(None).cast("long")
    at = ["client_id", F.unix_micros("ts").alias("us")]
    rows = commands.select(*at, F.lit(0).alias("turn"), F.col("command").alias("kind"), "task_id", none.alias("after_count"))
    rows = rows.unionByName(counts.select(*at, F.lit(1).alias("turn"), F.lit("count").alias("kind"), "task_id", "after_count"))
    rows = rows.unionByName(ticks.select(*at, F.lit(2).alias("turn"), F.lit("tick").alias("kind"), none.alias("task_id"), none.alias("after_count")))
    got = drain(st.stateful(stream(rocks, rows, tmp_path / "in", 2, ("us", "turn")), st.StatusFeed(), st.FEED_SCHEMA), tmp_path)
    batch = tasks.status_feed(ticks, commands, frames).select("client_id", F.unix_micros("ts"), "message").collect()
    assert sorted(got) == sorted(map(tuple, batch)) and len({m for *_, m in got}) > 10


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def run(df, write, path, mode="append"):
    query = df.writeStream.outputMode(mode).option("checkpointLocation", str(path)).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None


def test_segments_of_a_stream_answer_history(rocks, tmp_path):
    """Index and records of a stream whose store fails between its two writes, once, and again after its mark: history functions give what they give on the batch tables."""
    made = q.records(rocks, D).withColumn("result", F.to_json(F.struct("x", "y"), {"ignoreNullFields": "false"}))
    seen = F.col("event_type") != "view"
    shown = F.to_json(F.struct(F.when(seen, F.col("k") * 6).alias("x"), F.when(seen, F.floor("value").cast("int")).alias("y")), {"ignoreNullFields": "false"})
    live = stream(rocks, q.results(rocks, D).select("client_id", "frame_id", F.unix_micros("ts").alias("us"), "pipeline_ok", "task_id", shown.alias("result")), tmp_path / "in")
    failed = []

    class Failing(SegmentStore):
        def _write_index(self, rows, path):
            if not failed:
                failed.append("between")
                raise RuntimeError("lost")
            super()._write_index(rows, path)

        def write(self, rows, batch_id):
            super().write(rows, batch_id)
            if len(failed) == 1 and batch_id == 1:
                failed.append("after")
                raise RuntimeError("lost")

    store = Failing(str(tmp_path / "store"))
    assert store.index(rocks).count() == store.records(rocks).count() == 0
    for _ in range(3):
        query = st.stateful(live, st.Segments(10), st.SEGMENT_SCHEMA).writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(store.write).trigger(availableNow=True).start()
        try:
            query.awaitTermination(240)
        except Exception as e:  # noqa: BLE001
            assert "lost" in str(e)
        else:
            break
    assert failed == ["between", "after"]
    index, records, segs = store.index(rocks), store.records(rocks), q.segs(rocks, D)
    assert plain(index.select(segs.columns)) == plain(segs)
    assert plain(history.traceback_segments(index)) == plain(history.traceback_segments(segs)) and plain(history.playlists(index)) == plain(history.playlists(segs))
    same = ["client_id", "task_id", "segment_id", "segment_no", "segment_start_us", "pos", "frame_id", "ts", "result"]
    assert plain(records.select(same)) == plain(made.select(same))
    one = segs.where("kind = 'processed' and task_id is not null").orderBy("id").first()
    got = history.segment_keypoints(index, records, one["task_id"], one["id"]).select(same).collect()
    assert got == history.segment_keypoints(segs, made, one["task_id"], one["id"]).select(same).collect() and len(got) == 10
    assert plain(history.all_keypoints(records).select("frame_id", "frame_no", "total_frames")) == plain(history.all_keypoints(made).select("frame_id", "frame_no", "total_frames"))


def test_null_rows_do_not_stop_a_stream(rocks, tmp_path):
    """Null flags count as false, in the batch operators too; rows without a client or time are left out."""
    base = rows(rocks).where("frame_id % 5 <> 0").unionByName(rows(rocks).where("frame_id % 5 = 0").withColumn("pipeline_ok", F.lit(None).cast("boolean")))
    base = base.withColumn("bent", F.when(F.col("frame_id") % 3 != 0, F.col("bent")))
    bad = rocks.createDataFrame([(None, 1, 1, True, 1, True), ("camera_00001", 2, None, None, None, None)], base.schema)
    live = lambda: stream(rocks, base.unionByName(bad), tmp_path / "in") if not (tmp_path / "in").exists() else rocks.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    frames = base.withColumn("ts", F.timestamp_micros("us"))
    got = drain(st.stateful(live(), st.ClientCounts(), st.COUNT_SCHEMA), tmp_path / "a")
    batch = ops.running_bending(frames).select("client_id", "frame_id", "task_id", "stored_count", "after_count")
    assert sorted(got, key=str) == plain(batch)
    got = drain(st.stateful(live(), st.SegmentFrames(10), st.ASSIGNED_SCHEMA), tmp_path / "b")
    assert sorted(got, key=str) == plain(ops.assign_segments(frames, 10).select("client_id", "frame_id", "raw_segment", "raw_pos", "ok_segment", "ok_pos"))
    got = drain(st.index_rows(st.stateful(live(), st.Segments(10), st.SEGMENT_SCHEMA)), tmp_path / "c")
    assert sorted(got, key=str) == plain(ops.segments(frames, 10))


def test_counters_leave_with_their_client(rocks, tmp_path):
    """A removed row clears the counts of all tasks of its client, and of no other."""
    frame = lambda i, client, task, removed=False: (client, i, i, not removed, task, True, removed)
    data = [frame(1, "a", 1), frame(2, "a", 2), frame(3, "a", 1), frame(4, "b", 3), frame(5, "a", None, True), frame(6, "a", 1), frame(7, "a", 2), frame(8, "b", 3)]
    df = rocks.createDataFrame(data, "client_id string, frame_id long, us long, pipeline_ok boolean, task_id long, bent boolean, removed boolean")
    got = {r[1]: r[4] for r in drain(st.stateful(stream(rocks, df, tmp_path / "in", 4), st.ClientCounts(), st.COUNT_SCHEMA), tmp_path)}
    assert got == {1: 2, 2: 2, 3: 4, 4: 2, 6: 2, 7: 2, 8: 4}


def test_idle_state_goes(rocks, tmp_path):
    """Counts of a client that sends nothing for its time start anew; of one that goes on they don't."""
    schema = "client_id string, frame_id long, us long, pipeline_ok boolean, task_id long, bent boolean"
    add = lambda *frames: rocks.createDataFrame([(c, i, i, True, 1, False) for c, i in frames], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    add(("idle", 1), ("busy", 2))
    live = rocks.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = st.stateful(live, st.ClientCounts().expiring(12), st.COUNT_SCHEMA).writeStream.option("checkpointLocation", str(tmp_path / "state"))
    query = query.foreachBatch(lambda b, i: got.extend((r["client_id"], r["after_count"]) for r in b.collect())).trigger(processingTime="1 second").start()
    count = lambda c: sum(x == c for x, _ in got)
    wait = lambda ready: next((True for _ in range(60) if ready() or time.sleep(1)), False)
    try:
        assert wait(lambda: count("idle") == 1)
        for n in range(8):
            add(("busy", 3 + n))
            assert wait(lambda: count("busy") == n + 2)
            time.sleep(2)
        add(("idle", 20))
        assert wait(lambda: count("idle") == 2)
    finally:
        query.stop()
    assert [n for c, n in got if c == "idle"] == [1, 1] and [n for c, n in got if c == "busy"] == list(range(1, 10))


def test_status_messages_from_a_clock(rocks, tmp_path):
    """No tick rows: each known client gets a message a second, those that send nothing more too, until it leaves."""
    schema = "client_id string, us long, turn int, kind string, task_id long, after_count long, removed boolean"
    log = [("a", 1, 0, "initialize", 7, None, False), ("a", 2, 0, "start", 7, None, False), ("a", 3, 1, "count", 7, 5, False), ("b", 1, 0, "hello", None, None, False), ("c", 1, 0, "initialize", 9, None, False)]
    rocks.createDataFrame(log, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live, got = rocks.readStream.schema(schema).parquet(str(tmp_path / "in")), []
    query = st.stateful(live, st.StatusClock(), st.FEED_SCHEMA).writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, i: got.extend(b.collect())).trigger(processingTime="1 second").start()
    try:
        wait = lambda ready: next((True for _ in range(90) if ready() or time.sleep(1)), False)
        count = lambda c: sum(r["client_id"] == c for r in got)
        assert wait(lambda: min(count(c) for c in "abc") >= 3)
        rocks.createDataFrame([("c", 9, 0, "", None, None, True)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        before = count("a")
        assert wait(lambda: count("a") >= before + 4)
        stopped = count("c")
        assert wait(lambda: count("a") >= before + 7) and count("c") == stopped
    finally:
        query.stop()
    messages = {c: {r["message"] for r in got if r["client_id"] == c} for c in "abc"}
    assert messages["b"] == {'{"status":"no_active_task"}'} and len(messages["a"]) == 1
    assert '"task_id":7' in min(messages["a"]) and '"running"' in min(messages["a"]) and '"bending_count":5' in min(messages["a"])
    times = [r["us"] for r in got if r["client_id"] == "a"]
    assert all(b - a >= 1_000_000 for a, b in zip(times, times[1:]))


def test_latest_as_a_table(rocks, tmp_path):
    """The table has the newest frames after each batch, without clients that left; a batch written again changes nothing."""
    base = rows(rocks).withColumn("result", F.to_json(F.struct("bent"))).withColumn("removed", F.lit(False))
    top = base.agg(F.max("us")).first()[0]
    gone = base.where("client_id = 'camera_00003'").limit(1).select("client_id", F.lit(1 << 60).alias("frame_id"), F.lit(top + 1).alias("us"), F.lit(False).alias("pipeline_ok"), F.lit(True).alias("removed"))
    table, written = LatestTable(str(tmp_path / "table")), []
    assert table.read(rocks).count() == 0

    def write(batch, i):
        table.write(batch, i)
        written.append(plain(table.read(rocks)))
        table.write(batch.where("no = 1"), i)
        assert plain(table.read(rocks)) == written[-1]

    run(st.stateful(stream(rocks, base.unionByName(gone, allowMissingColumns=True), tmp_path / "in"), st.Latest(5), st.LATEST_SCHEMA, mode="update"), write, tmp_path / "state", "update")
    expected = ops.recent(base.withColumn("ts", F.timestamp_micros("us")), 5).where("client_id <> 'camera_00003'").select("client_id", "no", "frame_id", "us", "result")
    assert len(written) == 3 and written[-1] == plain(expected) and written[0] != written[-1]
    assert len(list((tmp_path / "table").glob("version-*"))) == 2


def test_playlists_as_text(spark, tmp_path):
    """A playlist of many entries is a few files, and with the others gives the bytes of the bodies."""
    ids = spark.range(20_000).withColumn("playlist_path", F.when(F.col("id") % 100 == 0, F.concat(F.lit("c"), (F.col("id") % 300).cast("string"), F.lit("/1/hls/raw_playlist.m3u8"))).otherwise("hot/2/hls/raw_playlist.m3u8"))
    segs = ids.select("id", "playlist_path", (F.col("id") % 7 + 144).alias("n_frames"), F.timestamp_seconds(F.col("id") * 7919 % 20_011).alias("start_ts"), F.concat(F.lit("x/raw_segment_"), F.col("id").cast("string"), F.lit(".mp4")).alias("segment_path"))
    write_playlists(segs, str(tmp_path / "out"), parts=4)
    got = {unquote(folder.name.removeprefix("playlist=")): "".join(f.read_text() for f in sorted(folder.glob("part-*"))) for folder in (tmp_path / "out").glob("playlist=*")}
    assert got == {r["playlist_path"]: r["body"] for r in history.playlists(segs).collect()}
    assert len(list((tmp_path / "out" / "playlist=hot%2F2%2Fhls%2Fraw_playlist.m3u8").glob("part-*"))) == 4


def test_images_as_a_stream(spark, tmp_path):
    """New files are rows of later batches; all of them are what the batch read gives."""
    put = lambda client, name, data: [(tmp_path / "in" / client).mkdir(parents=True, exist_ok=True), (tmp_path / "in" / client / name).write_bytes(data)]
    put("a", "1.jpg", b"one")
    live, got = read_images(spark, str(tmp_path / "in"), streaming=True), []
    write = lambda b, i: got.append(plain(b))
    run(live, write, tmp_path / "state")
    put("a", "2.jpg", b"two"), put("b", "1.jpg", b"three")
    run(live, write, tmp_path / "state")
    assert [len(x) for x in got] == [1, 2] and sorted(sum(got, []), key=str) == plain(read_images(spark, str(tmp_path / "in")))
    assert {(r[0], bytes(r[3])) for r in sum(got, [])} == {("a", b"one"), ("a", b"two"), ("b", b"three")}


def test_stream_running_counts_equal_batch(rocks, tmp_path):
    live = stream(rocks, rows(rocks).where("task_id is not null"), tmp_path / "in")
    got = drain(st.stateful(live, st.RunningCounts(), st.COUNT_SCHEMA, key="task_id"), tmp_path)
    batch = q.running_bending(rocks, D).where("task_id is not null").collect()
    assert sorted(got) == sorted(map(tuple, batch))


def test_stream_task_status_equals_fold(rocks, tmp_path):
    commands = src.commands(rocks, D).withColumn("us", F.unix_micros("ts"))
    got = drain(st.stateful(stream(rocks, commands, tmp_path / "in"), st.TaskStatus(), st.STATUS_SCHEMA), tmp_path)
    last = {t: (s, us // 1_000_000) for _, t, s, us in sorted(got, key=lambda r: (r[1], r[3]))}
    assert last == {r["task_id"]: (r["status"], r["updated_at"]) for r in tasks.fold_tasks(src.commands(rocks, D)).collect()}


def test_sources_and_sinks(spark, tmp_path):
    f = src.frames(spark, D).select("client_id", "frame_id", "ts", "width", "height", "pipeline_ok")
    f.write.parquet(str(tmp_path / "frames"))
    assert read_frames(spark, str(tmp_path / "frames")).count() == f.count() and read_frames(spark, str(tmp_path / "frames"), streaming=True).isStreaming
    assert read_table(spark, "frames", str(tmp_path)).count() == f.count()
    kp = q.records(spark, D).select("client_id", "task_id", "segment_start_us", "pos", "ts", "x", "y", F.lit(0).cast("long").alias("bending_count"))
    for _ in range(2):  # a repeated write leaves its records once
        write_keypoints(kp, str(tmp_path / "kp"))
    back = read_keypoints(spark, str(tmp_path / "kp")).select(kp.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, kp.collect()))
    for _ in range(2):  # a repeated batch leaves its rows once
        append_segments(q.segs(spark, D), str(tmp_path / "index"), 3)
    assert spark.read.parquet(str(tmp_path / "index")).count() == q.segs(spark, D).count()


def test_stage_registry(spark):
    from proctrace.operators.stages import Registry, Stage

    def detect(batch: pd.DataFrame, model):
        if (batch["frame_id"] % 7 == 0).any():
            raise ValueError("bad frame")
        return [{"n": int(i % 5)} for i in batch["frame_id"]]

    def grade(batch, model):
        return [{"score": 100.0 - model * d["n"]} if d["success"] else {"success": False, "error": "needs detection"} for d in batch["detection"]]

    r = Registry()
    r.register(Stage("grade", "score double", grade, requires=["detection"], setup=lambda: 5))
    r.register(Stage("detection", "n int", detect))
    r.register(Stage("off", "z int", detect, enabled=False))
    assert [s.name for s in r.ordered()] == ["detection", "grade"]
    out = r.run(spark.range(20).withColumnRenamed("id", "frame_id")).collect()
    assert len(out) == 20
    for x in out:
        bad = x["frame_id"] % 7 == 0
        assert x["detection"]["success"] is not bad and x["grade"]["success"] is not bad
        assert x["grade"]["score"] == (None if bad else 100.0 - 5 * (x["frame_id"] % 5))
    assert r.enable("off") and len(r.ordered()) == 3 and r.unregister("off") and not r.unregister("off")


def test_column_stages(spark):
    """Bubbles and cleanliness stay in the JVM; a batch stage may need them, and what isn't there is missing."""
    from proctrace.operators.stages import Registry, Stage, bubble_stage, cleanliness_stage

    circle = "array<struct<x:double,y:double,radius:double>>"
    frames = spark.createDataFrame([(0, []), (1, [(0.5, 1.5, 2.5)] * 3), (2, None)], f"frame_id long, circles {circle}")
    r = Registry()
    r.register(cleanliness_stage())
    r.register(Stage("label", "text string", lambda b, _: [{"text": f"{c['grade']} {o}"} for c, o in zip(b["cleanliness"], b["other"])], requires=["cleanliness", "other"]))
    r.register(bubble_stage())
    assert [s.name for s in r.ordered()] == ["bubble_detection", "cleanliness", "label"]
    got = {x["frame_id"]: x for x in r.run(frames).collect()}
    assert [got[i]["cleanliness"]["score"] for i in range(3)] == [100.0, 85.0, 100.0]
    assert [got[i]["label"]["text"] for i in range(3)] == ["Excellent None", "Good None", "Excellent None"]
    assert [tuple(got[i]["bubble_detection"])[:3] for i in range(3)] == [(True, None, 0), (True, None, 3), (False, "no circles", None)]
    assert tuple(got[1]["bubble_detection"]["circles"][0]) == (0, 2, 2)
    assert r.enable("bubble_detection", False)
    assert [x["cleanliness"]["score"] for x in r.run(frames).collect()] == [100.0] * 3


def test_normalized_boxes_and_jdbc(spark):
    from proctrace.operators.detections import normalize_boxes

    boxes = spark.createDataFrame([(1, [-1.7, 2.9, 3.0, 4.2]), (2, [])], "id long, box array<double>")
    assert [r["bbox"] for r in normalize_boxes(boxes).orderBy("id").collect()] == [[-1, 2, 3, 4], []]
    opts = {"url": "jdbc:derby:memory:stored;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).selectExpr("id as task_id", "id % 3 as status").write.format("jdbc").options(dbtable="clean_task", **opts).save()
    back = read_table(spark, "clean_task", jdbc_opts=opts, split=("task_id", 20, 60, 4))
    assert back.rdd.getNumPartitions() == 4 and sorted(map(tuple, back.collect())) == [(i, i % 3) for i in range(100)]
