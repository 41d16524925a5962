"""Detection boxes and the stages' results on frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proctrace.functions.scalars import fixed


def with_class_name(det: DataFrame, classes: DataFrame) -> DataFrame:
    """classes is the model's own list: a few dozen rows."""
    named = det.join(F.broadcast(classes), "class_id", "left")
    return named.withColumn("class_name", F.coalesce("class_name", F.concat(F.lit("class_"), F.col("class_id").cast("string"))))


def filter_confidence(det: DataFrame, conf: float = 0.8) -> DataFrame:
    return det.where(F.col("confidence") > conf)


def truncated(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("int")


def normalize_boxes(det: DataFrame, corners: str = "box") -> DataFrame:
    """Adds ``bbox``, the corners (an array of numbers) cut to whole pixels toward zero."""
    return det.withColumn("bbox", F.transform(corners, truncated))


def nms(det: DataFrame, iou: float = 0.45) -> DataFrame:
    """Greedy overlap suppression by confidence within frame and class; ties go to the smaller box number."""
    sides = ("x1", "y1", "x2", "y2")
    box = F.struct((-F.col("confidence")).alias("order"), "box_no", "confidence", *[F.col(c).cast("double").alias(c) for c in sides])
    grouped = det.groupBy("frame_id", "class_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    shared = lambda a, b, lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))

    def overlap(a: Column, b: Column) -> Column:
        common = shared(a, b, "x1", "x2") * shared(a, b, "y1", "y2")
        return common > iou * (area(a) + area(b) - common)

    none = F.filter("boxes", lambda _: F.lit(False))
    keep = lambda kept, b: F.when(F.exists(kept, lambda a: overlap(a, b)), kept).otherwise(F.array_append(kept, b))
    # most frames have a box or a few of a class
    chosen = F.when(F.size("boxes") == 1, F.col("boxes")).otherwise(F.aggregate("boxes", none, keep))
    return grouped.select("frame_id", "class_id", F.explode(chosen).alias("box")).select("frame_id", "class_id", "box.box_no")


def bending_per_frame(named: DataFrame) -> DataFrame:
    """Per frame with boxes: whether one is bent, how many are, and their names."""
    bent = F.lower("class_name").rlike("bent|bending")
    return named.groupBy("client_id", "frame_id").agg(F.bool_or(bent).alias("bent"), F.count_if(bent).alias("n_bent"), F.count("*").alias("n_boxes"), F.array_join(F.array_sort(F.collect_list("class_name")), ",").alias("names"))


def cleanliness(bubbles: Column, ok: Column) -> tuple[Column, Column]:
    """Score and grade from the number of bubbles; a failed stage has none."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - 5.0 * F.coalesce(bubbles, F.lit(0))))
    grade = F.when(score >= 90, "Excellent").when(score >= 70, "Good").when(score >= 50, "Fair").otherwise("Poor")
    return F.when(ok, score).otherwise(F.lit(0.0)), F.when(ok, grade).otherwise(F.lit("Unknown"))


def motion_actions(task_id: Column, mock: Column) -> Column:
    """mock: of the keypoints, null where there are none."""
    ready = task_id.isNotNull() & mock.isNotNull()
    actions = F.when(ready, F.struct(mock.alias("bending_detected"), F.lit(False).alias("bubble_detected"), F.lit("unknown").alias("submersion_status")))
    return F.struct(ready.alias("success"), F.when(~ready, "Missing task or keypoints").alias("error"), actions.alias("actions"))


def stains(contours: DataFrame, min_area: float = 100.0) -> DataFrame:
    return contours.where(F.col("area") > min_area).groupBy("client_id", "frame_no").agg(F.count("*").alias("n_stains"), F.max("area").alias("largest"))


def bubbles(circles: Column) -> Column:
    """circles: array of (x, y, radius) -> count, detected and the circles rounded, halves to the even number."""
    whole = F.transform(circles, lambda c: F.struct(*[F.bround(c[k]).cast("int").alias(k) for k in ("x", "y", "radius")]))
    return F.struct(F.size(circles).alias("bubble_count"), (F.size(circles) > 0).alias("detected"), whole.alias("circles"))


def bending_label(bent: Column, n: Column) -> Column:
    return F.when(bent, F.concat(F.lit("BENDING DETECTED! Count: "), n.cast("string"))).otherwise(F.concat(F.lit("Normal - Bending Count: "), n.cast("string")))


def task_label(task_id: Column, n: Column) -> Column:
    return F.concat(F.lit("Task ID: "), task_id.cast("string"), F.lit(" | Bending: "), n.cast("string"))


def cleanliness_label(grade: Column, score: Column) -> Column:
    return F.concat(F.lit("Cleanliness: "), grade, F.lit(" ("), fixed(score, 1), F.lit(")"))


def bubble_label(n: Column) -> Column:
    return F.concat(F.lit("Bubbles: "), n.cast("string"))


def _dealt(frames: DataFrame, content: str, parts: int) -> DataFrame:
    """With the content's digest and a deal, which parts the frames without content; others have the deal 0."""
    others = [F.col(c) for c, kind in frames.dtypes if c != content and not kind.startswith("map")]
    return frames.withColumn("digest", F.sha2(F.col(content), 256)).withColumn("__deal", F.when(F.col(content).isNull(), F.pmod(F.xxhash64(*others), F.lit(parts))).otherwise(0).cast("int"))


def _with_results(keyed: DataFrame, once: DataFrame, parts: int) -> DataFrame:
    """Each frame with its digest's result, that of no content copied to each deal."""
    deals = F.explode(F.when(F.col("__digest").isNull(), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))
    once = once.withColumnRenamed("digest", "__digest").withColumn("__own", deals)
    same = F.col("digest").eqNullSafe(F.col("__digest")) & (F.col("__deal") == F.col("__own"))
    return keyed.join(once, same, "left").drop("__digest", "__deal", "__own")


def infer_distinct(frames: DataFrame, content: str, stage: Callable[[DataFrame], DataFrame], parts: int = 64) -> DataFrame:
    """Runs stage, a DataFrame function of (digest, content), once for each distinct content, null included; all frames get its result.

    Frames without content, however many, are dealt to ``parts`` groups.
    """
    keyed = _dealt(frames, content, parts)
    return _with_results(keyed, stage(keyed.select("digest", content).dropDuplicates(["digest"])), parts)


def infer_stored(frames: DataFrame, content: str, stage: Callable[[DataFrame], DataFrame], results: str, parts: int = 64) -> DataFrame:
    """As infer_distinct, with results kept in a table at the path ``results`` between runs: stage runs for contents not seen before.

    New results are appended before any is read, so a run that fails later has kept them. Runs at
    the same time may append a result twice; readers take one.
    """
    spark, keyed = frames.sparkSession, _dealt(frames, content, parts)
    distinct = keyed.select("digest", content).dropDuplicates(["digest"])
    try:
        seen = spark.read.parquet(results)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        new = distinct
    else:
        known = seen.select(F.col("digest").alias("__digest")).distinct()
        new = distinct.join(known, F.col("digest").eqNullSafe(F.col("__digest")), "left_anti")
    stage(new).write.mode("append").parquet(results)
    return _with_results(keyed, spark.read.parquet(results).dropDuplicates(["digest"]), parts)
