"""Readers of frame events, commands and stored results; batch and stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = "client_id string, frame_id bigint, ts timestamp, width int, height int, pipeline_ok boolean"
COMMANDS = "client_id string, ts timestamp, cmd_id bigint, command string, task_id bigint, actor_id bigint"
IMAGES = "path string, modificationTime timestamp, length bigint, content binary"
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
KEYPOINTS = "client_id string, task_id bigint, segment_start_us bigint, pos int, ts timestamp, x int, y int, bending_count bigint"


def read_frames(spark: SparkSession, path: str, streaming: bool = False, schema: str = FRAMES) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).parquet(path)


def read_images(spark: SparkSession, path: str, streaming: bool = False, schema: str = IMAGES) -> DataFrame:
    """Stored frame images with their content; the client is the folder that holds them, the time that of the file's arrival.

    As a stream, files that come later are rows of later batches.
    """
    reader = (spark.readStream.schema(schema) if streaming else spark.read).format("binaryFile")
    files = reader.option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("client_id"), F.col("modificationTime").alias("ts"), "path", "content")


def read_table(spark: SparkSession, name: str, root: str | None = None, jdbc_opts: dict[str, str] | None = None, split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A stored table: over JDBC if options are given, else Parquet under root.

    split: column, lower and upper bound and number of tasks for a read over JDBC; rows beyond
    the bounds are read by the first and last task. Without it one task reads the table.
    """
    if jdbc_opts:
        reader = spark.read.format("jdbc").options(dbtable=name, **jdbc_opts)
        if split:
            column, low, high, parts = split
            reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
        return reader.load()
    return spark.read.parquet(f"{root}/{name}")


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Makes tables available to spark.sql."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def write_keypoints(keypoints: DataFrame, root: str, batch_id: int = 0) -> None:
    """JSON records of each segment, in order, in folders by batch, client and task; a batch written again replaces itself."""
    one = keypoints.withColumn("task", F.coalesce(F.col("task_id").cast("string"), F.lit("no_task")))
    one = one.repartition("client_id", "task", "segment_start_us").sortWithinPartitions("client_id", "task", "segment_start_us", "pos")
    one.write.partitionBy("client_id", "task").option("ignoreNullFields", False).option("timestampFormat", MICROS).mode("overwrite").json(f"{root}/batch_id={batch_id}")


def read_keypoints(spark: SparkSession, root: str) -> DataFrame:
    fields = [f for f in KEYPOINTS.split(", ") if not f.startswith("client_id")]
    return spark.read.schema(", ".join([*fields, "batch_id bigint", "client_id string", "task string"])).json(root).drop("task", "batch_id")


def append_segments(batch: DataFrame, root: str, batch_id: int) -> None:
    """Index rows of one micro-batch; a repeated batch replaces itself, so rows are all there or none, once."""
    batch.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")


def segment_sink(root: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of a stream of index rows."""
    return lambda batch, batch_id: append_segments(batch, root, batch_id)
