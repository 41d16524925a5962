"""Running values over the rows of a key in order, for keys of any size.

A key's rows fall into hours. Each hour's own total of a measure comes from an aggregate, which
shuffles a row for each key and hour; totals become prefixes over the hours of a key; each prefix
then comes as one more row, before the others, into the window of its key and hour, which gives
the values. So no window holds more rows than an hour of a key has (that of the prefixes: a row for
each of its hours), and rows with all their columns are shuffled once.

Where the whole input is small enough for one task, so is each key of it, and one window does it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Measure(NamedTuple):
    """kind: sum, since (the sum after the last marked row), last, least, or whole (the sum over all rows of the key).

    All but whole go up to and with the row; last and least pass over nulls.
    """

    kind: str
    value: Column


def counted(when: Column | None = None) -> Column:
    """1 where the condition holds, else 0."""
    return F.lit(1).cast("long") if when is None else F.when(when, 1).otherwise(0).cast("long")


#: Bytes of files up to which the input counts as small enough for one task; a setting of the session by this name goes first.
ONE_TASK = ("proctrace.oneTaskBytes", 32 << 20)


def fits_one_task(df: DataFrame) -> bool:
    """Whether the files and local rows that df comes from are no more than one task can do; known without a job. Rows sent from Python are of unknown size, so no."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        total += int(str(leaves.next().stats().sizeInBytes()))
    return total <= int(df.sparkSession.conf.get(ONE_TASK[0], str(ONE_TASK[1])))


def _prefixes(hourly: DataFrame, keys: list[str], order: tuple[str, ...], measures: dict[str, Measure], mark: Column | None) -> DataFrame:
    """A row for each key and hour, with what each measure is before the hour."""
    rank, group = F.struct(*order), [*keys, "__hour"]
    before = W.partitionBy(*keys).orderBy("__hour").rowsBetween(W.unboundedPreceding, -1)
    upto = before.rowsBetween(W.unboundedPreceding, 0)
    own, prefix = {}, {}
    if mark is not None:
        ends = hourly.where(mark).groupBy(*[F.col(c).alias(f"__of_{c}") for c in group]).agg(F.max(rank).alias("__end"))
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in group])
        hourly = hourly.join(ends, same, "left")
        own["__marked"] = F.count("__end") > 0
    for name, (kind, x) in measures.items():
        t, p = f"__total_{name}", f"__prefix_{name}"
        if kind == "last":
            own[t], prefix[p] = F.max_by(x, F.when(x.isNotNull(), rank)), F.last(t, ignorenulls=True).over(before)
        elif kind == "least":
            own[t], prefix[p] = F.min(x), F.min(t).over(before)
        elif kind == "whole":
            own[t], prefix[p] = F.sum(x), F.sum(t).over(W.partitionBy(*keys))
        else:
            own[t], prefix[p] = F.sum(x), F.sum(t).over(before)
        if kind == "since":
            own[f"__tail_{name}"] = F.coalesce(F.sum(F.when(F.col("__end").isNull() | (rank > F.col("__end")), x)), F.lit(0))
            prefix[p] = prefix[p] + F.coalesce(F.last(f"__base_{name}", ignorenulls=True).over(before), F.lit(0))
    hours = hourly.groupBy(*group).agg(*[c.alias(n) for n, c in own.items()])
    # what a marked hour leaves behind, less all that was up to its end
    bases = {f"__base_{n}": F.when(F.col("__marked"), F.col(f"__tail_{n}") - F.sum(f"__total_{n}").over(upto)) for n, m in measures.items() if m.kind == "since"}
    hours = hours.withColumns(bases) if bases else hours
    return hours.select(*group, *[c.alias(n) for n, c in prefix.items()])


def running(df: DataFrame, keys: list[str], order: tuple[str, ...], measures: dict[str, Measure], at: Column | None = None, mark: Column | None = None) -> DataFrame:
    """df with a column for each measure.

    at: the time, if it isn't the first column of the order; it may not fall along the order. mark:
    the rows from which sums of the kind since start anew. Rows without a time come first; rows
    with the same null key are one key.
    """
    upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    first, whole, rows = F.lit(False), W.partitionBy(*keys), df
    if not (single := fits_one_task(df)):
        hour = F.coalesce(F.date_trunc("hour", F.col(order[0]) if at is None else at), F.lit("0001-01-01").cast("timestamp"))
        hourly = df.withColumn("__hour", hour)
        rows = hourly.withColumn("__turn_", F.lit(1)).unionByName(_prefixes(hourly, keys, order, measures, mark).withColumn("__turn_", F.lit(0)), allowMissingColumns=True)
        upto = W.partitionBy(*keys, "__hour").orderBy("__turn_", *order).rowsBetween(W.unboundedPreceding, 0)
        first = F.col("__turn_") == 0
    out, more = {}, {}
    for name, (kind, x) in measures.items():
        p = None if single else F.col(f"__prefix_{name}")
        x = x if single else F.when(first, p).otherwise(x)
        if kind == "last":
            out[name] = F.last(x, ignorenulls=True).over(upto)
        elif kind == "least":
            out[name] = F.min(x).over(upto)
        elif kind == "whole":
            out[name] = F.sum(x).over(whole) if single else F.last(p, ignorenulls=True).over(upto)
        else:
            out[name] = F.coalesce(F.sum(x).over(upto), F.lit(0).cast("long"))
        if kind == "since":
            more[name] = F.col(name) - F.coalesce(F.last(F.when(~first & mark, F.col(name)), ignorenulls=True).over(upto), F.lit(0))
    rows = rows.withColumns(out)
    rows = rows.withColumns(more) if more else rows
    return rows if single else rows.where(~first).drop("__hour", "__turn_", *[f"__prefix_{n}" for n in measures])
