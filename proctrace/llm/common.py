"""What several operators share: staged tables, text keys and word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contracts: white space is the space and U+0009 to U+000D.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="proctrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, *partitions: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts lineage, keeps what is used twice, survives lost executors, and lets Spark
    remove the shuffle files that led to it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        if partitions:
            writer = writer.partitionBy(*partitions)
        writer.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*staged: DataFrame) -> None:
    """Remove staged tables that nothing left to compute reads."""
    for df in staged:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Text of ASCII alone takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_key(text: Column) -> Column:
    """With the row's id, this tells rows apart; rows alike in both have the same result."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def same_row(left: DataFrame, right: DataFrame, id_col: str = "doc_id", key: str = "text_key") -> Column:
    return left[id_col].eqNullSafe(right[id_col]) & (left[key] == right[key])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row.

    What a lambda of a higher-order function captures is computed anew for each element, unless
    it is a column or, as here, another lambda's argument.
    """
    return F.transform(F.array(value), use)[0]


def scanned(values: Column, start: Column, step: Callable[[Column, Column], Column], chunk: int = 256) -> Column:
    """The states after each element of an array, as an array: state' = step(state, element).

    Elements are taken in chunks, so that what grows by appending stays short: near linear in
    the number of elements.
    """

    def run(v: Column) -> Column:
        n = F.size(v)
        chunks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))).otherwise(F.array().cast("array<int>"))
        # by element: slice() would copy the whole array for each chunk
        places = lambda c: F.sequence(c * chunk, F.least(c * chunk + chunk, n) - 1)
        none = F.filter(F.array(start), lambda _: F.lit(False))
        one = lambda acc, i: bound(step(acc["state"], F.get(v, i)), lambda new: F.struct(new.alias("state"), F.array_append(acc["all"], new).alias("all")))
        part = lambda state, c: F.aggregate(places(c), F.struct(state.alias("state"), none.alias("all")), one)
        both = lambda acc, c: bound(part(acc["state"], c), lambda p: F.struct(p["state"].alias("state"), F.array_append(acc["parts"], p["all"]).alias("parts")))
        parts = F.filter(F.array(none), lambda _: F.lit(False))
        return F.aggregate(chunks, F.struct(start.alias("state"), parts.alias("parts")), both, lambda acc: F.flatten(acc["parts"]))

    return bound(values, run)


def running_sum(values: Column) -> Column:
    """For each element of an array of longs the sum up to and with it."""
    return scanned(values, F.lit(0).cast("long"), lambda acc, x: acc + x)
