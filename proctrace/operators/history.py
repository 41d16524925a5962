"""History queries over the segment index and stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proctrace.functions.scalars import fixed, iso
from proctrace.operators.scans import Measure, counted, running

#: Fixed by the playlist format.
HEADER = "#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:10\n"


def lookup(df: DataFrame, **equal) -> DataFrame:
    """The row with these values, or none."""
    for c, v in equal.items():
        df = df.where(F.col(c) == v)
    return df.limit(1)


def with_kind(segments: DataFrame) -> DataFrame:
    """raw or processed by the path; null where it names neither."""
    names = lambda k: F.contains("segment_path", F.lit(f"{k}_segment"))
    return segments.withColumn("kind", F.when(names("raw"), "raw").when(names("processed"), "processed"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def playlist_entry(fps: int) -> Column:
    """The two lines of a segment."""
    return F.concat(F.lit("#EXTINF:"), fixed(F.col("n_frames") / float(fps), 3), F.lit(",\n"), file_name(F.col("segment_path")), F.lit("\n"))


def playlists(segments: DataFrame, fps: int = 30) -> DataFrame:
    """The text of each playlist, segments in order, as one value; ``sources.store.write_playlists`` writes them to files without that."""
    rows = segments.groupBy("playlist_path").agg(F.array_sort(F.collect_list(F.struct("start_ts", "id", playlist_entry(fps).alias("entry")))).alias("x"))
    return rows.select("playlist_path", F.concat(F.lit(HEADER), F.array_join("x.entry", "")).alias("body"), F.size("x").cast("long").alias("n_segments"))


def traceback_segments(segments: DataFrame, task_id: int | None = None, kind: str = "processed") -> DataFrame:
    """A task's segments (every task's, without an id) by start, with the total and the first playlist of the task."""
    rows = segments.where(F.col("kind") == kind).where(F.col("task_id").isNotNull() if task_id is None else F.col("task_id") == task_id)
    per_task = W.partitionBy("task_id").orderBy("start_ts", "id")
    whole = W.partitionBy("task_id")
    return rows.select(
        "task_id", F.row_number().over(per_task).alias("no"), F.col("id").alias("segment_id"), "segment_path", iso(F.col("start_ts")).alias("start_time"), iso(F.col("end_ts")).alias("end_time"), "client_id", "keypoints_path",
        F.count("*").over(whole).alias("total_segments"), F.first("playlist_path").over(per_task.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("playlist_path"),
    )


def first_playlist(segments: DataFrame) -> DataFrame:
    return segments.where("task_id is not null").groupBy("task_id").agg(F.min_by("playlist_path", F.struct("start_ts", "id")).alias("playlist_path"))


def traceback_playlist(segments: DataFrame, kind: str) -> DataFrame:
    """For each task the playlist of a kind beside that of its first segment."""
    return first_playlist(segments).withColumn("playlist_path", F.regexp_replace("playlist_path", "[^/]+$", f"{kind}_playlist.m3u8"))


def segment_lookup(segments: DataFrame, task_id: int, segment_id: int) -> DataFrame:
    one = lookup(segments, task_id=task_id, id=segment_id)
    return one.select(F.col("id").alias("segment_id"), "task_id", "segment_path", file_name(F.col("segment_path")).alias("file_name"))


def segments_with_keypoints(segments: DataFrame, keypoints: DataFrame) -> DataFrame:
    """Segments with how many stored records they have; raw ones, and those without a file, have no path."""
    n = keypoints.groupBy("client_id", "segment_start_us").agg(F.count("*").alias("n_records"))
    rows = segments.withColumn("segment_start_us", F.unix_micros("start_ts")).join(n, ["client_id", "segment_start_us"], "left")
    there = (F.col("kind") == "processed") & F.col("n_records").isNotNull()
    return rows.withColumn("keypoints_path", F.when(there, F.col("keypoints_path"))).withColumn("n_records", F.when(there, F.col("n_records")))


def segment_keypoints(segments: DataFrame, keypoints: DataFrame, task_id: int, segment_id: int) -> DataFrame:
    """The records of one segment in order; a raw segment raises an error, when the rows are asked for."""
    one = lookup(segments, task_id=task_id, id=segment_id)
    stored = F.when(F.col("kind") == "raw", F.raise_error(F.lit("raw segments have no keypoints"))).otherwise(F.lit("processed"))
    one = one.select("client_id", F.unix_micros("start_ts").alias("segment_start_us"), stored.alias("__kind")).where("__kind = 'processed'").drop("__kind")
    return keypoints.join(one, ["client_id", "segment_start_us"]).orderBy("pos")


def all_keypoints(keypoints: DataFrame) -> DataFrame:
    """All records of every task, segments by start, with each task's number of frames."""
    rows = keypoints.where("task_id is not null")
    numbers = {"frame_no": Measure("sum", counted()), "total_frames": Measure("whole", counted())}
    rows = running(rows, ["task_id"], ("segment_start_us", "segment_id", "pos"), numbers, at=F.timestamp_micros("segment_start_us"))
    return rows.withColumn("frame_no", F.col("frame_no").cast("int"))
