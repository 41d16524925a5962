"""Streams with a small state for each client; each equals its batch operator on the same rows.

Rows are put in order (ts, frame_id) within a micro-batch; across micro-batches arrival order
rules. Rows without a key or time are left out; a null flag counts as false. A row with ``removed``
true clears its client's state, as a client's leaving does; with ``expiring`` so does time without
rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SEGMENT_SCHEMA = (
    "what string, id bigint, client_id string, task_id bigint, kind string, segment_no bigint, n_frames bigint, start_us bigint, end_us bigint, "
    "segment_path string, playlist_path string, keypoints_path string, frame_id bigint, us bigint, pos int, result string"
)
THROTTLE_SCHEMA = "client_id string, frame_id bigint, us bigint"
ASSIGNED_SCHEMA = "client_id string, frame_id bigint, raw_segment bigint, raw_pos int, ok_segment bigint, ok_pos int"
LATEST_SCHEMA = "client_id string, no int, frame_id bigint, us bigint, result string"
FEED_SCHEMA = "client_id string, us bigint, message string"
COUNT_SCHEMA = "client_id string, frame_id bigint, task_id bigint, stored_count bigint, after_count bigint"
STATUS_SCHEMA = "client_id string, task_id bigint, status string, updated_us bigint"


class _Client(StatefulProcessor):
    """One value of state per client; subclasses say its schema, and what a batch of rows does to it."""

    state_schema = ""
    empty: tuple = ()
    order = ["us", "frame_id"]
    clock = "None"
    ttl_ms: int | None = None

    def expiring(self, seconds: float) -> _Client:
        """State that no row has written for so long goes (of a map, each entry by itself)."""
        self.ttl_ms, self.clock = int(seconds * 1000), "ProcessingTime"
        return self

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.state_schema, self.ttl_ms)

    def load(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else self.empty

    def save(self, now: tuple) -> None:
        if now == self.empty:
            self.state.clear()
        else:
            self.state.update(now)

    def ordered(self, rows) -> Iterator:
        return pd.concat(list(rows)).sort_values(self.order, kind="stable").itertuples(index=False)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, out = self.load(), []
        for row in self.ordered(rows):
            if _yes(getattr(row, "removed", False)):
                now = self.empty
            else:
                now = self.fold(key[0], now, row, out)
        out = self.finish(key[0], now, out)
        self.save(now)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def fold(self, client, now, row, out):
        raise NotImplementedError

    def finish(self, client, now, out):
        return out

    def close(self) -> None:
        pass


def _task(x) -> int | None:
    return None if pd.isna(x) else int(x)


def _yes(x) -> bool:
    return not pd.isna(x) and bool(x)


class Segments(_Client):
    """As a client's count fills, the segment's two index rows and a record for each of its frames.

    ``what`` tells them apart (segment, record); index_rows and record_rows give each in its own
    form. State is the segment's number and the frames since it began, with their ``result`` (JSON
    text, if the rows have it).
    """

    columns = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]

    def __init__(self, length: int):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "n bigint, held bigint", self.ttl_ms)
        self.frames = handle.getListState("frames", "frame_id bigint, us bigint, result string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, stored = (int(x) for x in self.head.get()) if self.head.exists() else (0, 0)
        new, fresh, out = [], False, []
        for row in self.ordered(rows):
            if _yes(getattr(row, "removed", False)):
                n, stored, new, fresh = 0, 0, [], True
            elif _yes(row.pipeline_ok):
                new.append((int(row.frame_id), int(row.us), getattr(row, "result", None)))
                if stored + len(new) == self.length:
                    frames = [tuple(x) for x in self.frames.get()] + new if stored else new
                    out += self.rows(key[0], n, _task(row.task_id), frames)
                    n, stored, new, fresh = n + 1, 0, [], True
        if fresh:
            self.frames.clear()
        if new:
            self.frames.appendList(new)
        if (n, stored + len(new)) == (0, 0):
            self.head.clear()
        else:
            self.head.update((n, stored + len(new)))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    @staticmethod
    def rows(client: str, n: int, task: int | None, frames: list[tuple]) -> Iterator[tuple]:
        start, end, last = frames[0][1], frames[-1][1], frames[-1][0]
        folder = f"{client}/{'no_task' if task is None else task}/hls"
        for kind in ("raw", "processed"):
            stored = kind == "processed"
            paths = (f"{folder}/{kind}_segment_{start}.mp4", f"{folder}/{kind}_playlist.m3u8", f"{folder}/keypoints_{start}.json" if stored else None)
            yield ("segment", 2 * last + stored, client, task, kind, n, len(frames), start, end, *paths, None, None, None, None)
        for pos, (frame_id, us, result) in enumerate(frames):
            yield ("record", 2 * last + 1, client, task, None, n, None, start, None, None, None, None, frame_id, us, pos, result)


def index_rows(rows: DataFrame) -> DataFrame:
    """Of the rows of Segments those of the index, as ``frames.segments`` gives them."""
    times = [F.timestamp_micros(f"{c}_us").alias(f"{c}_ts") for c in ("start", "end")]
    return rows.where("what = 'segment'").select("id", "client_id", "task_id", "kind", "segment_no", "n_frames", *times, "segment_path", "playlist_path", "keypoints_path")


def record_rows(rows: DataFrame) -> DataFrame:
    """Of the rows of Segments the frames' records, as ``frames.keypoint_frames`` gives them."""
    return rows.where("what = 'record'").select("client_id", "task_id", F.col("id").alias("segment_id"), "segment_no", F.col("start_us").alias("segment_start_us"), "pos", "frame_id", F.timestamp_micros("us").alias("ts"), "result")


class Throttle(_Client):
    state_schema = "seen boolean, last_us bigint"
    empty = (False, 0)
    columns = [c.split()[0] for c in THROTTLE_SCHEMA.split(", ")]

    def __init__(self, seconds: float):
        self.step = int(seconds * 1_000_000)

    def fold(self, client, now, row, out):
        seen, last = now
        if seen and row.us - last < self.step:
            return now
        out.append((client, row.frame_id, row.us))
        return True, int(row.us)


class SegmentFrames(_Client):
    """Each frame at once with its raw and processed segment and place in it; state is two counts."""

    state_schema = "raw bigint, ok bigint"
    empty = (0, 0)
    columns = [c.split()[0] for c in ASSIGNED_SCHEMA.split(", ")]

    def __init__(self, length: int):
        self.length = length

    def fold(self, client, now, row, out):
        raw, ok = now
        good = _yes(row.pipeline_ok)
        place = divmod(ok, self.length) if good else (None, None)
        out.append((client, row.frame_id, *divmod(raw, self.length), *place))
        return raw + 1, ok + good


class Latest(_Client):
    """The newest n processed frames with their results, newest first, after each batch; state is their list.

    Rows have ``result`` as text (JSON). A client that left gives one row with the number 0. For output
    mode update.
    """

    state_schema = "frame_id bigint, us bigint, result string"
    columns = [c.split()[0] for c in LATEST_SCHEMA.split(", ")]

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("newest", self.state_schema, self.ttl_ms)

    def load(self) -> tuple:
        return tuple(tuple(x) for x in self.state.get())

    def save(self, now: tuple) -> None:
        if now:
            self.state.put(list(now))
        else:
            self.state.clear()

    def fold(self, client, now, row, out):
        if not _yes(row.pipeline_ok):
            return now
        return (*now, (int(row.frame_id), int(row.us), row.result))[-self.n :]

    def finish(self, client, now, out):
        return [(client, no, *x) for no, x in enumerate(reversed(now), 1)] or [(client, 0, None, None, None)]


class RunningCounts(_Client):
    """Motion and bent counts; keyed by task in place of client."""

    state_schema = "motion bigint, bent bigint"
    empty = (0, 0)
    columns = [c.split()[0] for c in COUNT_SCHEMA.split(", ")]

    def fold(self, client, now, row, out):
        motion, bent = now
        if not _yes(row.pipeline_ok):
            return now
        bent += _yes(row.bent)
        out.append((row.client_id, row.frame_id, int(client), motion + bent, motion + 1 + bent))
        return motion + 1, bent


class ClientCounts(_Client):
    """Motion and bent counts of each task, under the client, so that a client that leaves takes all its tasks' counts along.

    State is a map from task to counts. Frames without a task count nothing.
    """

    columns = RunningCounts.columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("counts", "task_id bigint", "motion bigint, bent bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, out = {}, []
        for row in self.ordered(rows):
            if _yes(getattr(row, "removed", False)):
                self.state.clear()
                seen = {}
            elif _yes(row.pipeline_ok):
                task = _task(row.task_id)
                if task is None:
                    out.append((key[0], row.frame_id, None, 0, 0))
                    continue
                if task not in seen:
                    seen[task] = tuple(self.state.getValue((task,))) if self.state.containsKey((task,)) else (0, 0)
                motion, bent = seen[task][0], seen[task][1] + _yes(row.bent)
                out.append((key[0], row.frame_id, task, motion + bent, motion + 1 + bent))
                seen[task] = (motion + 1, bent)
        for task, counts in seen.items():
            self.state.updateValue((task,), counts)
        if out:
            yield pd.DataFrame(out, columns=self.columns)


class TaskStatus(_Client):
    """The client's current task and its status, after each batch of commands that changes it."""

    state_schema = "task_id bigint, status string, updated_us bigint"
    empty = (-1, "", 0)
    order = ["us", "cmd_id"]
    columns = [c.split()[0] for c in STATUS_SCHEMA.split(", ")]

    def fold(self, client, now, row, out):
        task = _task(row.task_id)
        if row.command == "initialize":
            now = (task, "initialized", int(row.us))
            out.append((client, *now))
        elif task is not None and task == now[0]:
            if row.command == "start":
                now = (task, "running", int(row.us))
                out.append((client, *now))
            else:
                out.append((client, task, "terminated", int(row.us)))
                now = self.empty
        return now


class StatusFeed(_Client):
    """The status message of each tick: of the client's current task, or that there is none.

    Rows are commands (turn 0, ``kind`` is the command), running counts (turn 1, kind count) and
    ticks (turn 2, kind tick), as one stream; turns order rows of the same time.
    """

    state_schema = "task_id bigint, status string, updated_us bigint, counted bigint, bending bigint"
    empty = (-1, "", 0, -1, 0)
    order = ["us", "turn"]
    columns = [c.split()[0] for c in FEED_SCHEMA.split(", ")]

    def fold(self, client, now, row, out):
        task, status, at, counted, bending = now
        named = _task(row.task_id)
        if row.kind == "tick":
            out.append((client, row.us, self.message(now)))
        elif row.kind == "count":
            if named is not None:
                counted, bending = named, int(row.after_count)
        elif row.kind == "initialize":
            task, status, at = named, "initialized", int(row.us)
        elif named is not None and named == task:
            task, status, at = (task, "running", int(row.us)) if row.kind == "start" else self.empty[:3]
        return task, status, at, counted, bending

    @staticmethod
    def message(now: tuple) -> str:
        task, status, at, counted, bending = now
        if task < 0:
            return '{"status":"no_active_task"}'
        updated = datetime.fromtimestamp(at // 1_000_000, UTC).strftime("%Y-%m-%dT%H:%M:%S")
        fields = {"task_id": task, "status": status, "cleaning_stage": "0", "bending_count": bending if counted == task else 0, "bubble_detected": False, "fully_submerged": False, "updated_at": updated}
        return json.dumps(fields, separators=(",", ":"))


class StatusClock(StatusFeed):
    """The status message of each second from a timer, for every client that any row was of, until a ``removed`` row.

    Rows are those of StatusFeed without ticks; one of the kind hello makes a client known that has
    no task. A message's time is its timer's.
    """

    clock = "ProcessingTime"

    def __init__(self, seconds: float = 1.0):
        self.step = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, left = self.load(), False
        for row in self.ordered(rows):
            left = _yes(getattr(row, "removed", False))
            now = self.empty if left else now if row.kind == "hello" else self.fold(key[0], now, row, [])
        self.save(now)
        timers = list(self.handle.listTimers())
        if left:
            for t in timers:
                self.handle.deleteTimer(t)
        elif not timers:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.step)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        self.handle.registerTimer(max(due, timerValues.getCurrentProcessingTimeInMs()) + self.step)
        yield pd.DataFrame([(key[0], due * 1000, self.message(self.load()))], columns=self.columns)


def stateful(rows: DataFrame, processor: _Client, schema: str, key: str = "client_id", mode: str = "append") -> DataFrame:
    """rows: a stream with the key, ``us`` (ts in microseconds) and the processor's columns. Needs the RocksDB state store."""
    known = rows.where(F.col(key).isNotNull() & F.col("us").isNotNull())
    return known.groupBy(key).transformWithStateInPandas(processor, outputStructType=schema, outputMode=mode, timeMode=processor.clock)
