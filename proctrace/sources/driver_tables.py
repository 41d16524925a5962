"""Canonical tables derived from the driver's events, lineitem and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the derivation.
CLASSES = [(0, "straight"), (1, "Bent_tube"), (2, "bending")]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("camera_"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("client_id"),
        F.col("event_id").alias("frame_id"), F.timestamp_micros(F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "UTC"))).alias("ts"),
        "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    size = F.col("k") % 3
    width = F.when(size == 0, 640).when(size == 1, 1280).otherwise(1920)
    height = F.when(size == 0, 480).when(size == 1, 720).otherwise(1080)
    return e.select("client_id", "frame_id", "ts", width.alias("width"), height.alias("height"), (F.col("event_type") != "error").alias("pipeline_ok"), "k", "value", "event_type", (F.col("k") % 25).alias("bubble_count"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("event_type").isin("signup", "click", "purchase"))
    order = W.partitionBy("client_id").orderBy("ts", "frame_id").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "signup", F.col("frame_id")), ignorenulls=True).over(order)
    named = F.when(F.col("event_type") == "signup", "initialize").when(F.col("event_type") == "click", "start").otherwise("terminate")
    task = F.when(F.col("event_type") == "signup", F.col("frame_id")).otherwise(last - F.when(F.col("k") % 10 == 0, 1).otherwise(0))
    return e.select("client_id", "ts", F.col("frame_id").alias("cmd_id"), named.alias("command"), task.alias("task_id"), F.col("user_id").alias("actor_id"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box for each frame."""
    e = events(spark, sf_dir)
    return e.select("client_id", "frame_id", F.lit(1).alias("box_no"), (F.col("k") % 4).alias("class_id"), (1 - F.col("value") / 500.0).alias("confidence"))


def many_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several boxes a frame: (frame_id, box_no, class_id, confidence, x1, y1, x2, y2)."""
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    box = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    side = 40 + F.col("l_quantity").cast("int")
    x1, y1 = ((F.col("l_partkey") * 7) % 100).cast("int"), ((F.col("l_suppkey") * 13) % 100).cast("int")
    conf = (F.round(F.col("l_extendedprice") * 100).cast("bigint") % 1000) / 1000.0
    return l.select(F.col("l_orderkey").alias("frame_id"), box.alias("box_no"), (F.col("l_partkey") % 2).cast("int").alias("class_id"), conf.alias("confidence"), x1.alias("x1"), y1.alias("y1"), (x1 + side).alias("x2"), (y1 + side).alias("y2"))


def classes(spark: SparkSession) -> DataFrame:
    return spark.range(len(CLASSES)).select(F.col("id").cast("int").alias("class_id"), F.element_at(F.array(*[F.lit(n) for _, n in CLASSES]), (F.col("id") + 1).cast("int")).alias("class_name"))


def upload_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "error").when(kind == "view", "no_response").when(kind == "signup", "encode_error").otherwise("success")
    return events(spark, sf_dir).select("client_id", "ts", F.col("frame_id").alias("seq"), outcome.alias("outcome"))
