"""Tables that a stream writes batch by batch and others read at any time.

What a batch writes is not seen until its mark is there: a small file, put in place by one rename
after all else is written. A batch that is repeated after its mark does nothing; one that failed
before it writes anew what nobody has seen. Batches are known by their number, so a stream that
starts from a new checkpoint needs a new ``run``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proctrace.sources.tables import MICROS
from proctrace.streaming.stateful import LATEST_SCHEMA, index_rows, record_rows

INDEX = "id bigint, client_id string, task_id bigint, kind string, segment_no bigint, n_frames bigint, start_ts timestamp, end_ts timestamp, segment_path string, playlist_path string, keypoints_path string"
RECORDS = "client_id string, task_id bigint, segment_id bigint, segment_no bigint, segment_start_us bigint, pos int, frame_id bigint, ts timestamp, result string"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _files(spark, path)
    return fs.exists(where)


def publish(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all."""
    fs, where = _files(spark, path)
    _, part = _files(spark, f"{where.getParent()}/_{where.getName()}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(part, where)


def _consume(rows: DataFrame) -> None:
    """For a batch whose rows are there already: its state has to be computed all the same."""
    rows.write.format("noop").mode("overwrite").save()


class SegmentStore:
    """Index rows (Parquet) and frame records (JSON) of a stream of Segments, for foreachBatch: ``write`` is its function."""

    def __init__(self, root: str, run: str = "0"):
        self.root, self.run = root.rstrip("/"), run

    def write(self, rows: DataFrame, batch_id: int) -> None:
        spark, mark = rows.sparkSession, f"{self.root}/marks/{self.run}-{batch_id}.json"
        if exists(spark, mark):
            return _consume(rows)
        rows = rows.persist()
        try:
            self._write_records(rows, self._at("records", batch_id))
            self._write_index(rows, self._at("index", batch_id))
        finally:
            rows.unpersist()
        publish(spark, mark, f'{{"run": "{self.run}", "batch_id": {batch_id}}}\n')

    def _at(self, part: str, batch_id: int) -> str:
        return f"{self.root}/{part}/run={self.run}/batch_id={batch_id}"

    def _write_records(self, rows: DataFrame, path: str) -> None:
        records = record_rows(rows).repartition("client_id", "task_id", "segment_id").sortWithinPartitions("client_id", "segment_id", "pos")
        records.write.mode("overwrite").option("ignoreNullFields", False).option("timestampFormat", MICROS).json(path)

    def _write_index(self, rows: DataFrame, path: str) -> None:
        index_rows(rows).write.mode("overwrite").parquet(path)

    def index(self, spark: SparkSession) -> DataFrame:
        """The segment index, as the history functions take it."""
        return self._seen(spark, "index", "parquet", INDEX)

    def records(self, spark: SparkSession) -> DataFrame:
        """The frames' records; result is JSON text."""
        return self._seen(spark, "records", "json", RECORDS)

    def _seen(self, spark: SparkSession, part: str, kind: str, schema: str) -> DataFrame:
        if not exists(spark, f"{self.root}/marks"):
            return spark.createDataFrame([], schema)
        marks = spark.read.schema("run string, batch_id bigint").json(f"{self.root}/marks")
        rows = spark.read.schema(f"{schema}, run string, batch_id bigint").format(kind).load(f"{self.root}/{part}")
        return rows.join(marks, ["run", "batch_id"], "left_semi").drop("run", "batch_id")


class LatestTable:
    """The newest frames of each client as of the last batch, from a stream of Latest in output mode update.

    Each batch writes a new version of the table, then its mark; readers take the newest marked
    version, and the one before it stays for readers that have begun.
    """

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        done = self._versions(spark)
        if done and batch_id <= done[-1]:
            return _consume(rows)
        rows = rows.persist()
        try:
            table = rows.where("no > 0")
            if done:
                table = self.read(spark).join(rows.select("client_id").distinct(), "client_id", "left_anti").unionByName(table)
            table.write.mode("overwrite").parquet(f"{self.root}/version-{batch_id}")
        finally:
            rows.unpersist()
        publish(spark, f"{self.root}/marks/{batch_id}", "")
        for old in done[:-1]:
            for path in (f"{self.root}/marks/{old}", f"{self.root}/version-{old}"):
                fs, where = _files(spark, path)
                fs.delete(where, True)

    def _versions(self, spark: SparkSession) -> list[int]:
        fs, where = _files(spark, f"{self.root}/marks")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()) if fs.exists(where) else []

    def read(self, spark: SparkSession) -> DataFrame:
        done = self._versions(spark)
        return spark.read.schema(LATEST_SCHEMA).parquet(f"{self.root}/version-{done[-1]}") if done else spark.createDataFrame([], LATEST_SCHEMA)


def write_playlists(segments: DataFrame, root: str, fps: int = 30, parts: int | None = None) -> None:
    """Each playlist as text in the folder ``playlist=`` and its path (escaped), entries in order.

    Entries are dealt by ranges of (playlist, start, id) and sorted within, so a playlist of any
    length is a few files: their lines in the order of the files' names are the playlist. No row
    holds more than an entry.
    """
    from proctrace.operators.history import HEADER, playlist_entry

    entries = segments.select(F.col("playlist_path").alias("playlist"), F.lit(1).alias("turn"), "start_ts", "id", F.rtrim(playlist_entry(fps), F.lit("\n")).alias("value"))
    heads = entries.select("playlist").distinct().select("playlist", F.lit(0).alias("turn"), F.lit(None).cast("timestamp").alias("start_ts"), F.lit(None).cast("long").alias("id"), F.lit(HEADER.rstrip("\n")).alias("value"))
    order = ["playlist", "turn", "start_ts", "id"]
    rows = entries.unionByName(heads)
    rows = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    rows.sortWithinPartitions(*order).select("playlist", "value").write.mode("overwrite").partitionBy("playlist").text(root)
