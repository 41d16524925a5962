"""Frames: attachment to tasks, thinning, numbering, segments, latest results, running counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proctrace.functions.scalars import bound
from proctrace.operators.scans import Measure, counted, fits_one_task, running

ORDER = ("ts", "frame_id")


def numbered(df: DataFrame, keys: list[str], name: str | None = None, order: tuple[str, ...] = ORDER, when: Column | None = None, **more: Column | None) -> DataFrame:
    """Adds the 1-based number of each row within its keys, in order; of rows where ``when`` holds, if given.

    more: further numbers, each by name with its condition, from the same pass.
    """
    wanted = ({name: when} if name else {}) | more
    out = running(df, keys, order, {k: Measure("sum", counted(c)) for k, c in wanted.items()})
    return out.withColumns({k: F.when(c, F.col(k)) for k, c in wanted.items() if c is not None}) if any(c is not None for c in wanted.values()) else out


def detect_center_box(frames: DataFrame) -> DataFrame:
    """The centre point and a box of a quarter of the frame, at most 200 pixels a side."""
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    side = lambda c: F.least(F.lit(200), F.floor(F.col(c) / 4).cast("int"))
    reach = lambda c: F.floor(side(c) / 2).cast("int")
    return frames.select(
        "client_id", "frame_id", half("width").alias("cx"), half("height").alias("cy"),
        F.greatest(F.lit(0), half("width") - reach("width")).alias("x1"), F.greatest(F.lit(0), half("height") - reach("height")).alias("y1"),
        F.least("width", half("width") + reach("width")).alias("x2"), F.least("height", half("height") + reach("height")).alias("y2"), F.lit(True).alias("mock"),
    )


def attach_task(frames: DataFrame, accepted: DataFrame, numbers: bool = False, bending: bool = False) -> DataFrame:
    """Each frame with the task set on its client then: an as-of join by union and running values.

    accepted: commands that took effect. One of the same time as a frame comes before it. numbers:
    also raw_no and ok_no, the frame's number on its client among all frames and, if its pipeline
    succeeded, among those where it did; what cuts segments uses them and needs no pass of its own.
    bending: also the counters of running_bending, from the frames' column bent, since the task was set.
    """
    marks = accepted.where("command in ('initialize', 'terminate')")
    state = F.struct(F.when(F.col("command") == "initialize", F.col("task_id")).alias("task_id"))
    left = marks.select("client_id", "ts", F.col("cmd_id").alias("frame_id"), F.lit(0).alias("__turn"), state.alias("__mark"))
    both = frames.withColumn("__turn", F.lit(1)).unionByName(left, allowMissingColumns=True)
    frame = F.col("__turn") == 1
    ok = frame & F.col("pipeline_ok")
    measures = {"__state": Measure("last", F.col("__mark"))}
    if numbers:
        measures |= {"raw_no": Measure("sum", counted(frame)), "ok_no": Measure("sum", counted(ok))}
    if bending:
        measures |= {"__motion": Measure("since", counted(ok)), "__bent": Measure("since", counted(ok & F.col("bent")))}
    both = running(both, ["client_id"], ("ts", "__turn", "frame_id"), measures, mark=~frame if bending else None).where(frame)
    if numbers:
        both = both.withColumn("ok_no", F.when(F.col("pipeline_ok"), F.col("ok_no")))
    both = both.withColumn("task_id", F.col("__state.task_id")).drop("__turn", "__mark", "__state")
    return _bending_counts(both) if bending else both


def _bending_counts(counted_rows: DataFrame) -> DataFrame:
    """From the processed and bent frames of the task so far to the counter that the bending stage stores, and that after both stages."""
    none = F.lit(0).cast("long")
    count = lambda c: F.when(F.col("pipeline_ok"), F.when(F.col("task_id").isNull(), none).otherwise(c))
    rows = counted_rows.withColumn("stored_count", count(F.col("__motion") - 1 + F.col("__bent"))).withColumn("after_count", count(F.col("__motion") + F.col("__bent")))
    return rows.drop("__motion", "__bent")


def throttle(frames: DataFrame, seconds: float, steps: int = 1024, fan: int = 4096) -> DataFrame:
    """Frames at least ``seconds`` after the last kept one of their client; the first is kept.

    What is kept later depends only on the time from which a frame may be kept again, so a stretch
    of time is a map from that time before it to that time after it. The map of a bucket (``steps``
    times seconds of a client) holds an entry for each frame that can be its first kept one: those
    in its first ``seconds``, and the one after. Maps of ``fan`` buckets are composed to the map of a
    group, and those of a client's groups give where each group starts; going down again, where each
    bucket starts and which of its frames are kept. Only client, time and id take that way.

    A bucket's frames and a group's maps are one row each. Where the whole input is small enough for one
    task, each client is one bucket. Of rows alike in client, time and id one is
    kept; frames without a client or time are kept, and change nothing.
    """
    step = int(seconds * 1_000_000)
    width, least = step * steps, -(1 << 62)
    placed = F.col("client_id").isNotNull() & F.col("ts").isNotNull()
    timed = frames.where(placed).select(F.col("client_id").alias("__client"), F.unix_micros("ts").alias("us"), "frame_id")
    single = fits_one_task(frames)
    timed = timed.withColumn("bucket", F.lit(0).cast("long") if single else F.floor(F.col("us") / width).cast("long"))
    # how many frames of the bucket come before the time at which the next one may be kept
    early = W.partitionBy("__client", "bucket").orderBy("us").rangeBetween(W.unboundedPreceding, step - 1)
    buckets = timed.withColumn("next", F.count("*").over(early).cast("int")).groupBy("__client", "bucket").agg(F.array_sort(F.collect_list(F.struct("us", "frame_id", "next"))).alias("f"))

    def entries(f: Column) -> Column:
        """(at, leave) of each frame that can be the bucket's first kept one."""
        n = F.size(f)
        follow = lambda i: F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(steps + 1))), i, lambda j, _: F.when(F.get(f, j)["next"] < n, F.get(f, j)["next"]).otherwise(j))
        first = F.least(F.size(F.filter(f, lambda x: x["us"] < (F.col("bucket") * width + step))), n - 1)
        return F.transform(F.sequence(F.lit(0), first), lambda i: F.struct(F.get(f, i)["us"].alias("at"), (F.get(f, follow(i))["us"] + step).alias("leave")))

    def applied(own: Column, start: Column) -> Column:
        """Where a stretch with these entries is left."""
        return F.coalesce(F.get(F.filter(own, lambda e: e["at"] >= start), F.lit(0))["leave"], start)

    def composed(maps: Column) -> Column:
        """Entries of consecutive stretches: those of the first, and the first of the second."""
        ats = F.concat(F.transform(F.get(maps, F.lit(0))["own"], lambda e: e["at"]), F.filter(F.array(F.get(F.get(maps, F.lit(1))["own"], F.lit(0))["at"]), lambda x: x.isNotNull()))
        return F.transform(ats, lambda x: F.struct(x.alias("at"), F.aggregate(maps, x, lambda start, m: applied(m["own"], start)).alias("leave")))

    def starts(maps: Column, start: Column) -> Column:
        """(no, start) of each stretch, the first one's start given."""
        none = F.filter(F.array(F.struct(F.lit(0).cast("long").alias("no"), F.lit(0).cast("long").alias("start"))), lambda _: F.lit(False))
        go = lambda acc, m: F.struct(applied(m["own"], acc["now"]).alias("now"), F.array_append(acc["all"], F.struct(m["no"].alias("no"), acc["now"].alias("start"))).alias("all"))
        return F.aggregate(maps, F.struct(start.alias("now"), none.alias("all")), go, lambda acc: acc["all"])

    def ordered(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("no", "own"))).alias("maps"))

    def bucket_starts() -> DataFrame:
        maps = buckets.select("__client", F.floor(F.col("bucket") / fan).cast("long").alias("group"), F.col("bucket").alias("no"), bound(F.col("f"), entries).alias("own"))
        groups = ordered(maps, "__client", "group")
        chain = ordered(groups.select("__client", F.col("group").alias("no"), bound(F.col("maps"), composed).alias("own")), "__client")
        at_group = chain.select("__client", F.explode(starts(F.col("maps"), F.lit(least))).alias("x")).select("__client", F.col("x.no").alias("group"), F.col("x.start").alias("start"))
        return groups.join(at_group, ["__client", "group"]).select("__client", F.explode(starts(F.col("maps"), F.col("start"))).alias("x")).select("__client", F.col("x.no").alias("bucket"), F.col("x.start").alias("start"))

    def kept(f: Column) -> Column:
        n, start = F.size(f), F.size(F.filter(f, lambda x: x["us"] < F.col("start")))
        none = F.filter(F.array(F.lit(0)), lambda _: F.lit(False))
        go = lambda acc, _: F.when(acc["i"] >= n, acc).otherwise(F.struct(F.get(f, acc["i"])["next"].alias("i"), F.array_append(acc["all"], acc["i"]).alias("all")))
        places = F.aggregate(F.sequence(F.lit(1), n if single else F.least(n, F.lit(steps + 1))), F.struct(start.alias("i"), none.alias("all")), go, lambda acc: acc["all"])
        return F.transform(places, lambda i: F.struct(F.get(f, i)["us"].alias("us"), F.get(f, i)["frame_id"].alias("id")))

    placed_buckets = buckets.withColumn("start", F.lit(least)) if single else buckets.join(bucket_starts(), ["__client", "bucket"])
    found = placed_buckets.select("__client", F.explode(bound(F.col("f"), kept)).alias("x"))
    found = found.select("__client", F.timestamp_micros("x.us").alias("__ts"), F.col("x.id").alias("__id"))
    same = (F.col("client_id") == F.col("__client")) & (F.col("ts") == F.col("__ts")) & F.col("frame_id").eqNullSafe(F.col("__id"))
    alike = W.partitionBy("client_id", "ts", "frame_id").orderBy(F.lit(0))
    whole = frames.where(placed).join(found, same, "left_semi").withColumn("__no", F.row_number().over(alike)).where("__no = 1").drop("__no")
    return whole.unionByName(frames.where(~placed))


def _numbered_frames(frames: DataFrame) -> DataFrame:
    """With raw_no and ok_no, which attach_task may have given."""
    if {"raw_no", "ok_no"} <= set(frames.columns):
        return frames
    return numbered(frames, ["client_id"], raw_no=None, ok_no=F.col("pipeline_ok"))


def assign_segments(frames: DataFrame, length: int) -> DataFrame:
    """Frames with their raw and processed segment and place in it, from 0; processed ones only where the pipeline succeeded."""
    both = _numbered_frames(frames)
    part = lambda c: F.floor((F.col(c) - 1) / length).cast("long")
    place = lambda c: ((F.col(c) - 1) % length).cast("int")
    return both.select("*", part("raw_no").alias("raw_segment"), place("raw_no").alias("raw_pos"), part("ok_no").alias("ok_segment"), place("ok_no").alias("ok_pos")).drop("raw_no", "ok_no")


def _processed(attached: DataFrame, length: int) -> DataFrame:
    """Frames that the pipeline processed, with their segment's number and their place in it."""
    no = F.col("ok_no") - 1
    return _numbered_frames(attached).where("pipeline_ok").withColumn("segment_no", F.floor(no / length).cast("long")).withColumn("pos", (no % length).cast("int"))


def segments(attached: DataFrame, length: int) -> DataFrame:
    """Two index rows for each complete segment of a client, raw and processed.

    Both carry the processed chunk's time range and the task of its last frame; ids are made
    of the last frame's.
    """
    ok = _processed(attached, length)
    chunk = ok.groupBy("client_id", "segment_no").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n_frames"), F.max_by(F.struct("task_id", "frame_id"), F.struct(*ORDER)).alias("last"))
    chunk = chunk.where(F.col("n_frames") == length)
    folder = F.concat_ws("/", "client_id", F.coalesce(F.col("last.task_id").cast("string"), F.lit("no_task")), F.lit("hls"))
    us = F.unix_micros("start_ts").cast("string")
    kinds = chunk.withColumn("kind", F.explode(F.array(F.lit("raw"), F.lit("processed"))))
    processed = F.col("kind") == "processed"
    return kinds.select(
        (F.col("last.frame_id") * 2 + processed.cast("int")).alias("id"), "client_id", F.col("last.task_id").alias("task_id"), "kind", "segment_no", "n_frames", "start_ts", "end_ts",
        F.concat(folder, F.lit("/"), "kind", F.lit("_segment_"), us, F.lit(".mp4")).alias("segment_path"),
        F.concat(folder, F.lit("/"), "kind", F.lit("_playlist.m3u8")).alias("playlist_path"),
        F.when(processed, F.concat(folder, F.lit("/keypoints_"), us, F.lit(".json"))).alias("keypoints_path"),
    )


def keypoint_frames(attached: DataFrame, length: int) -> DataFrame:
    """The stored record of each frame of a complete processed segment, with the segment's id, task and start.

    Windows hold one segment each, so nothing is joined back.
    """
    ok = _processed(attached, length)
    chunk = W.partitionBy("client_id", "segment_no")
    whole = chunk.orderBy(*ORDER).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    last = F.last(F.struct("task_id", "frame_id")).over(whole)
    ok = ok.withColumn("__last", last).withColumn("__first", F.first("ts").over(whole)).withColumn("__n", F.count("*").over(chunk)).where(F.col("__n") == length)
    ok = ok.withColumn("task_id", F.col("__last.task_id")).withColumn("segment_id", F.col("__last.frame_id") * 2 + 1).withColumn("segment_start_us", F.unix_micros("__first"))
    return ok.drop("raw_no", "ok_no", "__last", "__first", "__n")


def recent(frames: DataFrame, n: int) -> DataFrame:
    """The newest n processed frames of each client, newest first."""
    newest = F.row_number().over(W.partitionBy("client_id").orderBy(F.desc("ts"), F.desc("frame_id")))
    return frames.where("pipeline_ok").withColumn("no", newest).where(F.col("no") <= n)


def latest(frames: DataFrame) -> DataFrame:
    """The newest processed frame of each client."""
    fields = [F.col(c) for c in frames.columns if c != "client_id"]
    best = frames.where("pipeline_ok").groupBy("client_id").agg(F.max_by(F.struct(*fields), F.struct(*ORDER)).alias("x"))
    return best.select("client_id", "x.*")


def running_bending(attached: DataFrame, failed: bool = False) -> DataFrame:
    """attached: frames with task_id and bent -> the counter as the bending stage stores it, and after both stages.

    The motion stage counts every processed frame of a task, after the bending stage has stored
    its result. failed: keep frames whose pipeline failed, with no counts. Frames without a task,
    which count nothing, are dealt by frame.
    """
    none = F.lit(0).cast("long")
    idle = F.col("task_id").isNull()
    rows = attached if failed else attached.where("pipeline_ok")
    rows = rows.withColumn("__task", F.coalesce("task_id", none)).withColumn("__idle", F.when(idle, F.coalesce("frame_id", none)).otherwise(F.lit(-1)))
    ok = F.col("pipeline_ok")
    rows = running(rows, ["__task", "__idle"], ORDER, {"__motion": Measure("sum", counted(ok)), "__bent": Measure("sum", counted(ok & F.col("bent")))})
    return _bending_counts(rows).drop("__task", "__idle")
