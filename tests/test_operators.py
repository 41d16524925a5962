"""Hand-worked cases, and plain-Python folds against the operators."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from proctrace.functions import scalars
from proctrace.operators import detections, frames, history, quality, tasks

T0 = dt.datetime(2024, 1, 1)
FRAME = "client_id string, frame_id long, ts timestamp, pipeline_ok boolean, task_id long, bent boolean, width int, height int"


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def frame(i, ms=None, ok=True, task=None, bent=False, client="c", size=(100, 100)):
    return (client, i, at(i * 100 if ms is None else ms), ok, task, bent, *size)


def command(i, s, name, task, client="c"):
    return (client, at(s * 1000), i, name, task, 9)


COMMAND = "client_id string, ts timestamp, cmd_id long, command string, task_id long, actor_id long"


def test_center_box(spark):
    sizes = [(100, 100), (640, 480), (1920, 1080), (3, 3)]
    got = frames.detect_center_box(spark.createDataFrame([frame(i, size=s) for i, s in enumerate(sizes)], FRAME)).orderBy("frame_id").select("x1", "y1", "x2", "y2").collect()
    assert [tuple(r) for r in got] == [(38, 38, 62, 62), (240, 180, 400, 300), (860, 440, 1060, 640), (1, 1, 1, 1)]


def test_cleanliness(spark):
    score, grade = detections.cleanliness(F.col("n"), F.col("ok"))
    df = spark.createDataFrame([(n, True) for n in (0, 2, 3, 6, 7, 10, 11, 25, None)] + [(0, False)], "n int, ok boolean").select(score, grade)
    assert [tuple(r) for r in df.collect()] == [(100, "Excellent"), (90, "Excellent"), (85, "Good"), (70, "Good"), (65, "Fair"), (50, "Fair"), (45, "Poor"), (0, "Poor"), (100, "Excellent"), (0, "Unknown")]


def test_names_bending_and_clamp(spark):
    det = spark.createDataFrame([("c", i, i) for i in range(4)], "client_id string, frame_id long, class_id int")
    named = detections.with_class_name(det, spark.createDataFrame([(0, "Bent_tube"), (1, "BENDING"), (2, "straight")], "class_id int, class_name string"))
    got = {r["frame_id"]: (r["bent"], r["names"]) for r in detections.bending_per_frame(named).collect()}
    assert got == {0: (True, "Bent_tube"), 1: (True, "BENDING"), 2: (False, "straight"), 3: (False, "class_3")}
    values = spark.createDataFrame([(-0.2,), (0.3,), (1.7,)], "x double").select(scalars.clamp01(F.col("x")), detections.truncated(F.col("x") * 10))
    assert [tuple(r) for r in values.collect()] == [(0.0, -2), (0.3, 3), (1.0, 17)]


def test_queues(spark):
    none = spark.createDataFrame([], "client_id string, rtmp_url string")
    status = lambda rows, as_of: tuple(quality.queue_status(spark.createDataFrame(rows, FRAME), none, as_of=F.lit(as_of)).first())[1:5]
    assert status([frame(0)], at(-1)) == (1, 0, 0, 0) and status([frame(0)], at(0)) == (0, 1, 1, 1)
    assert status([frame(i) for i in range(152)], at(10**8)) == (0, 2, 2, 30)


def test_segments(spark):
    rows = [frame(i, ok=i != 3, task=1 if i < 100 else 2) for i in range(151)]
    got = frames.segments(spark.createDataFrame(rows, FRAME), 150).collect()
    assert sorted(r["kind"] for r in got) == ["processed", "raw"] and {r["task_id"] for r in got} == {2}
    assert {(r["start_ts"], r["end_ts"]) for r in got} == {(at(0), at(15000))}
    assert frames.segments(spark.createDataFrame([frame(i) for i in range(149)], FRAME), 150).count() == 0


def test_playlist(spark):
    rows = [frame(i) for i in range(300)]
    text = history.playlists(frames.segments(spark.createDataFrame(rows, FRAME), 150)).where("playlist_path like '%raw%'").first()["body"]
    lines = text.splitlines()
    assert lines[:3] == ["#EXTM3U", "#EXT-X-VERSION:3", "#EXT-X-TARGETDURATION:10"] and lines[3] == lines[5] == "#EXTINF:5.000," and lines[4].startswith("raw_segment_") and len(lines) == 7


def test_throttle_by_hand(spark):
    rows = [frame(i, ms=m) for i, m in enumerate((0, 50, 100, 150, 210, 290, 320))]
    got = frames.throttle(spark.createDataFrame(rows, FRAME), 0.1).orderBy("ts").collect()
    assert [r["ts"] for r in got] == [at(m) for m in (0, 100, 210, 320)]


def test_running_bending(spark):
    rows = [frame(i, task=1, bent=b) for i, b in enumerate((False, True, True))]
    got = frames.running_bending(spark.createDataFrame(rows, FRAME)).orderBy("frame_id").collect()
    assert [(r["stored_count"], r["after_count"]) for r in got] == [(0, 1), (2, 3), (4, 5)]


def test_task_lifecycle_and_feed(spark):
    log = [command(1, 10, "initialize", 7), command(2, 12, "start", 7), command(3, 13, "start", 8), command(4, 20, "terminate", 7), command(5, 21, "start", 7)]
    df = spark.createDataFrame(log, COMMAND)
    row = tasks.fold_tasks(df).first()
    base = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())
    assert (row["status"], row["created_at"] - base, row["start_time"] - base, row["end_time"] - base, row["updated_at"] - base) == ("terminated", 10, 12, 20, 20)
    assert sorted(r["cmd_id"] for r in tasks.rejected_commands(df).collect()) == [3, 5]
    ticks = spark.createDataFrame([("c", at(s * 1000)) for s in (9, 15, 25)], "client_id string, ts timestamp")
    seen = spark.createDataFrame([frame(1, ms=14000, bent=True)], FRAME)
    feed = [r["message"] for r in tasks.status_feed(ticks, df, seen).orderBy("ts").collect()]
    assert feed[0] == feed[2] == '{"status":"no_active_task"}' and '"task_id":7' in feed[1] and '"bending_count":2' in feed[1] and '"running"' in feed[1]


def test_history(spark):
    rows = [(1, "c", 1, "raw", "/p/raw_segment_5.mp4", "/p/raw_playlist.m3u8", None, None, None), (2, "c", 1, "processed", "/p/processed_segment_5.mp4", "/p/processed_playlist.m3u8", "/p/keypoints_5.json", None, None)]
    segs = spark.createDataFrame(rows, "id long, client_id string, task_id long, kind string, segment_path string, playlist_path string, keypoints_path string, start_ts timestamp, end_ts timestamp")
    raw, ok = history.traceback_segments(segs, 1, "raw").collect(), history.traceback_segments(segs, 1).collect()
    assert len(raw) == len(ok) == 1 and raw[0]["keypoints_path"] is None and ok[0]["keypoints_path"] and ok[0]["start_time"] is None
    assert history.traceback_segments(segs, 999).count() == 0
    assert history.traceback_playlist(segs, "processed").first()["playlist_path"] == "/p/processed_playlist.m3u8"
    assert history.segment_lookup(segs, 1, 2).first()["file_name"] == "processed_segment_5.mp4"
    stored = spark.createDataFrame([], "client_id string, segment_start_us long, pos int")
    with pytest.raises(Exception, match="raw segments have no keypoints"):
        history.segment_keypoints(segs, stored, 1, 1).collect()
    assert history.segment_keypoints(segs, stored, 1, 2).collect() == []


def test_rates(spark):
    log = [("c", at(i * 30150 / 904), i, "success" if i < 900 else "error") for i in range(905)] + [("d", at(0), 1, "encode_error")]
    got = {r["client_id"]: r for r in quality.upload_stats(spark.createDataFrame(log, "client_id string, ts timestamp, seq long, outcome string")).collect()}
    assert round(got["c"]["success_rate"], 2) == 99.45 and round(got["c"]["average_fps"], 2) == 30.02
    assert (got["d"]["frames_sent"], got["d"]["frames_error"], got["d"]["success_rate"], got["d"]["average_fps"]) == (0, 1, 0.0, 0.0)
    many = [frame(i, ms=i * 30300 / 899, client="a") for i in range(900)] + [frame(i, ms=i * 30000 / 699, client="b") for i in range(700)]
    sla = {r["client_id"]: (round(r["avg_fps"], 1), r["passed"]) for r in quality.fps_sla(spark.createDataFrame(many, FRAME)).collect()}
    assert sla == {"a": (29.7, True), "b": (23.3, False)}


def test_trajectory(spark):
    rows = [(1, i, at(i), x, x) for i, x in enumerate((5, None, 7, 8))]
    got = quality.trajectory(spark.createDataFrame(rows, "task_id long, frame_id long, ts timestamp, x int, y int")).orderBy("index").collect()
    assert [r["alpha"] for r in got] == [0.0, 0.5, 0.75]


def test_nms_ties(spark):
    rows = [(1, 1, 0, 0.9, 0, 0, 10, 10), (1, 2, 0, 0.9, 1, 1, 11, 11), (1, 3, 1, 0.5, 0, 0, 10, 10), (1, 4, 0, 0.1, 50, 50, 60, 60)]
    det = spark.createDataFrame(rows, "frame_id long, box_no int, class_id int, confidence double, x1 int, y1 int, x2 int, y2 int")
    assert sorted(r["box_no"] for r in detections.nms(det).collect()) == [1, 3, 4]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(hs.lists(hs.tuples(hs.sampled_from("ab"), hs.integers(0, 60), hs.sampled_from(["frame", "initialize", "start", "terminate"]), hs.integers(0, 2)), min_size=1, max_size=40))
def test_fold_of_commands_and_frames(spark, items):
    """As-of tasks, acceptance, segments and throttling against one pass in Python."""
    items = sorted(items, key=lambda x: x[1])
    log, rows, expected, accepted, kept, last, made = [], [], [], [], [], {}, {}
    current = {}
    for i, (c, _, kind, task) in enumerate(items):
        ms = items[i][1] * 1000 + i
        if kind == "frame":
            rows.append(frame(i, ms=ms, client=c))
            expected.append((i, current.get(c)))
            if c not in last or ms - last[c] >= 5000:
                last[c] = ms
                kept.append(i)
            made.setdefault(c, []).append((i, current.get(c)))
        else:
            task = i if kind == "initialize" else (current.get(c, 0) or 0) - task // 2
            log.append(command(i, 0, kind, task, c)[:1] + (at(ms), i, kind, task, 9))
            if kind == "initialize" or current.get(c) == task:
                accepted.append(i)
                current[c] = task if kind == "initialize" else (None if kind == "terminate" else current[c])
    commands = spark.createDataFrame(log, COMMAND)
    fs = spark.createDataFrame(rows, FRAME).drop("task_id")
    good = tasks.accepted_commands(commands)
    assert sorted(r["cmd_id"] for r in good.collect()) == accepted
    attached = frames.attach_task(fs, good)
    assert sorted((r["frame_id"], r["task_id"]) for r in attached.collect()) == sorted(expected)
    assert sorted(r["frame_id"] for r in frames.throttle(fs, 5.0).collect()) == kept
    chunks = sorted((c, k, m[4 * k + 3][1]) for c, m in made.items() for k in range(len(m) // 4))
    got = frames.segments(attached, 4).where("kind = 'raw'").collect()
    assert sorted(((r["client_id"], r["segment_no"], r["task_id"]) for r in got), key=str) == sorted(chunks, key=str)


def test_results_kept_between_runs(spark, tmp_path):
    """The second run's stage sees new contents only; frames without content, half of all, are many groups."""
    calls = []

    def stage(df):
        calls.append(sorted((r["content"] for r in df.select("content").collect()), key=str))
        return df.select("digest", F.coalesce(F.length("content"), F.lit(-1)).alias("n"))

    make = lambda contents: spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "frame_id long, content string")
    first = make(["a", "a", "bb", None] + [None] * 40)
    got = detections.infer_stored(first, "content", stage, str(tmp_path / "r"))
    assert sorted((r["frame_id"], r["n"]) for r in got.collect()) == [(0, 1), (1, 1), (2, 2)] + [(i, -1) for i in range(3, 44)]
    again = detections.infer_stored(make(["a", "ccc", None]), "content", stage, str(tmp_path / "r"))
    assert sorted((r["frame_id"], r["n"]) for r in again.collect()) == [(0, 1), (1, 3), (2, -1)]
    assert calls == [[None, "a", "bb"], ["ccc"]] or calls == [["a", "bb", None], ["ccc"]]
    dealt = detections._dealt(first, "content", 64)
    assert dealt.where("content is null").select("__deal").distinct().count() > 10
    assert sorted((r["frame_id"], r["n"]) for r in detections.infer_distinct(first, "content", stage).collect()) == sorted((r["frame_id"], r["n"]) for r in got.collect())
