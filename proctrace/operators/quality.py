"""Counters, rates and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proctrace.functions.scalars import percent
from proctrace.operators.scans import Measure, counted, running


def queue_status(frames: DataFrame, clients: DataFrame, length: int = 150, live: int = 30, as_of: Column | None = None) -> DataFrame:
    """What each client's queues hold once all frames up to as_of are processed.

    Frames after as_of are submitted but not consumed.
    """
    done = F.lit(True) if as_of is None else F.col("ts") <= as_of
    counts = frames.groupBy("client_id").agg(F.count("*").alias("submitted"), F.count_if(done).alias("raw"), F.count_if(done & F.col("pipeline_ok")).alias("ok"))
    flushed = F.floor(F.col("ok") / length) * length
    rows = counts.select("client_id", (F.col("submitted") - F.col("raw")).alias("ca_ready"), (F.col("raw") - flushed).cast("long").alias("ca_raw"), (F.col("ok") - flushed).cast("long").alias("ca_processed"), F.least(F.lit(live), F.col("ok")).cast("long").alias("rt_processed"))
    return rows.join(clients, "client_id", "left")


def clients(commands: DataFrame) -> DataFrame:
    """The stream address of each client, the last written."""
    return commands.groupBy("client_id").agg(F.max_by("url", F.struct("ts", "cmd_id")).alias("rtmp_url"))


def upload_stats(log: DataFrame) -> DataFrame:
    """An encode failure counts as an error but wasn't sent; a missing answer counts as neither."""
    sent = F.col("outcome") != "encode_error"
    elapsed = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    rows = log.groupBy("client_id").agg(F.count_if(sent).alias("frames_sent"), F.count_if(F.col("outcome") == "success").alias("frames_success"), F.count_if(F.col("outcome").isin("error", "encode_error")).alias("frames_error"), elapsed.alias("elapsed_time"))
    fps = F.when(F.col("elapsed_time") > 0, F.col("frames_sent") / F.col("elapsed_time")).otherwise(0.0)
    return rows.withColumn("success_rate", percent(F.col("frames_success"), F.col("frames_sent"))).withColumn("average_fps", fps)


def fps_sla(frames: DataFrame, target: float = 30.0, share: float = 0.8, distinct: bool = False) -> DataFrame:
    n = F.count_distinct("frame_id") if distinct else F.count("*")
    rows = frames.groupBy("client_id").agg(n.alias("frames"), F.greatest(F.lit(1.0), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("duration"))
    return rows.withColumn("avg_fps", F.col("frames") / F.col("duration")).withColumn("passed", F.col("avg_fps") >= share * target)


def processing_rate(sent: DataFrame, received: DataFrame, distinct: bool = False) -> DataFrame:
    n = (lambda: F.count_distinct("frame_id")) if distinct else (lambda: F.count("*"))
    a, b = sent.groupBy("client_id").agg(n().alias("sent")), received.groupBy("client_id").agg(n().alias("received"))
    rows = a.join(b, "client_id", "left").withColumn("received", F.coalesce("received", F.lit(0)))
    return rows.withColumn("rate", percent(F.col("received"), F.col("sent")))


def task_summary(results: DataFrame) -> DataFrame:
    """Per task: frames, frames with a result, greatest and mean bending count."""
    return results.where("task_id is not null").groupBy("task_id").agg(F.count("*").alias("total_frames"), F.count_if("has_result").alias("frames_with_result"), F.max("bending_count").alias("max_bending"), F.round(F.avg("bending_count"), 2).alias("mean_bending"))


def stage_health(results: DataFrame, stages: list[str]) -> DataFrame:
    """results: a struct with success and error for each stage -> counts for each stage and error."""
    one = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"{s}.success").alias("success"), F.col(f"{s}.error").alias("error")) for s in stages]))
    return results.select(one.alias("x")).select("x.*").groupBy("stage", "error").agg(F.count_if("success").alias("n_success"), F.count_if(~F.col("success")).alias("n_error"))


def progress(log: DataFrame, every: int = 30) -> DataFrame:
    """Every n-th sent frame of a client: counts and rate so far."""
    outcome = F.col("outcome")
    seen = {"ok": Measure("sum", counted(outcome == "success")), "bad": Measure("sum", counted(outcome == "error")), "began": Measure("least", F.col("ts")), "frames_sent": Measure("sum", counted())}
    rows = running(log.where("outcome <> 'encode_error'"), ["client_id"], ("ts", "seq"), seen).where(F.col("frames_sent") % every == 0)
    elapsed = (F.unix_micros("ts") - F.unix_micros("began")) / 1e6
    return rows.select("client_id", "frames_sent", F.col("ok").alias("frames_success"), F.col("bad").alias("frames_error"), F.when(elapsed > 0, F.col("frames_sent") / elapsed).otherwise(0.0).alias("fps"))


def trajectory(records: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """A keypoint's places in each task in order; alpha is the share of the task's frames before it."""
    rows = running(records.where("task_id is not null"), ["task_id"], ("ts", "frame_id"), {"__no": Measure("sum", counted()), "total": Measure("whole", counted())})
    return rows.where(F.col(x).isNotNull()).select("task_id", (F.col("__no") - 1).cast("int").alias("index"), x, y, ((F.col("__no") - 1) / F.col("total")).alias("alpha"))
