"""The task life cycle, folded from the command log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proctrace.functions.scalars import epoch_text, iso
from proctrace.operators.scans import Measure, running

ORDER = ("ts", "cmd_id")


def judged(commands: DataFrame) -> DataFrame:
    """Commands with ``accepted``: start and terminate count only if they name the client's current task.

    The current task is the last one initialised on the client, until a terminate that names it.
    """
    upto = W.partitionBy("client_id").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("command") == "initialize", F.col("task_id")), ignorenulls=True).over(upto)
    turn = F.count_if(F.col("command") == "initialize").over(upto)
    df = commands.withColumn("__open", opened).withColumn("__turn", turn)
    named = F.col("task_id") == F.col("__open")
    ended = F.coalesce(F.count_if((F.col("command") == "terminate") & named).over(W.partitionBy("client_id", "__turn").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ok = (F.col("command") == "initialize") | (F.coalesce(named, F.lit(False)) & (ended == 0))
    return df.withColumn("accepted", ok).drop("__open", "__turn")


def accepted_commands(commands: DataFrame) -> DataFrame:
    return judged(commands).where("accepted").drop("accepted")


def rejected_commands(commands: DataFrame) -> DataFrame:
    return judged(commands).where(~F.col("accepted")).drop("accepted")


def fold_tasks(commands: DataFrame) -> DataFrame:
    """clean_task: one row for each initialised task, times in epoch seconds."""
    at = F.unix_seconds("ts")
    on = lambda c: F.when(F.col("command") == c, at)
    rows = accepted_commands(commands).groupBy("task_id").agg(
        F.max_by(F.when(F.col("command") == "initialize", F.col("actor_id")), F.when(F.col("command") == "initialize", F.struct(*ORDER))).alias("initiator_operator_id"),
        F.max_by("command", F.struct(*ORDER)).alias("last"), F.min(on("initialize")).alias("created_at"), F.max(at).alias("updated_at"),
        F.max(on("start")).alias("started"), F.max(on("terminate")).alias("ended"),
    )
    status = F.when(F.col("last") == "terminate", "terminated").when(F.col("last") == "start", "running").otherwise("initialized")
    return rows.select("task_id", "initiator_operator_id", F.lit("0").alias("current_step"), status.alias("status"), "created_at", "updated_at", F.coalesce("started", "created_at").alias("start_time"), F.coalesce("ended", F.lit(0)).alias("end_time"))


def task_listing(tasks: DataFrame, total: bool = True) -> DataFrame:
    """All tasks with the creation time as text, and how many there are."""
    rows = tasks.select("task_id", "initiator_operator_id", "current_step", "status", epoch_text(F.col("created_at")).alias("created_at"))
    return rows.join(F.broadcast(rows.agg(F.count("*").alias("total"))), F.lit(True)) if total else rows


def status_feed(ticks: DataFrame, commands: DataFrame, frames: DataFrame) -> DataFrame:
    """The status message of each tick (client_id, ts): of the client's current task, or that there is none.

    frames: (client_id, ts, pipeline_ok, bent); processed frames and bent ones count since their
    task was set. Commands and frames of a tick's own time come before it. Commands, frames and
    ticks are one timeline of their client, gone through once.
    """
    marks = accepted_commands(commands)
    live = F.when(F.col("command") != "terminate", F.struct("task_id", F.when(F.col("command") == "start", "running").otherwise("initialized").alias("status"), F.unix_seconds("ts").alias("updated_at")))
    a = marks.select("client_id", "ts", F.lit(0).alias("turn"), (F.col("command") != "start").alias("anew"), F.struct(live.alias("t")).alias("mark"))
    b = frames.where("pipeline_ok").select("client_id", "ts", F.lit(1).alias("turn"), (F.lit(1) + F.coalesce(F.col("bent"), F.lit(False)).cast("int")).cast("long").alias("n"))
    c = ticks.select("client_id", "ts", F.lit(2).alias("turn"))
    timeline = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    measures = {"state": Measure("last", F.col("mark")), "bending": Measure("since", F.coalesce("n", F.lit(0).cast("long")))}
    seen = running(timeline, ["client_id"], ("ts", "turn"), measures, mark=F.coalesce("anew", F.lit(False))).where("turn = 2")
    full = F.to_json(F.struct(F.col("state.t.task_id").alias("task_id"), F.col("state.t.status").alias("status"), F.lit("0").alias("cleaning_stage"), F.col("bending").alias("bending_count"), F.lit(False).alias("bubble_detected"), F.lit(False).alias("fully_submerged"), iso(F.timestamp_seconds("state.t.updated_at")).alias("updated_at")))
    return seen.select("client_id", "ts", F.when(F.col("state.t").isNull(), F.lit('{"status":"no_active_task"}')).otherwise(full).alias("message"))
