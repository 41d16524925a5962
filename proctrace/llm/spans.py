"""Where patterns match, as arrays of spans in code points, with built-in functions only.

Splitting by a pattern gives the gaps between its matches; lengths of gaps and matches, summed
along the row, give positions. Offsets count code points from 0, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proctrace.llm.common import bound, running_sum

SPAN = "array<struct<kind:string,rank:int,low:bigint,high:bigint>>"


def matches(text: Column, pattern: str, group: int | None = None, before: int | None = None) -> Column:
    """Leftmost non-overlapping matches: array of (low, high, match, part, before).

    part is the group's text; before, if asked for, at most that many characters before the match, back to
    where the match before it starts. Each array is computed once for a text; work grows with the text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.array().cast("array<string>") if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def placed(x: Column) -> Column:
        sizes = F.transform(x["found"], lambda m: F.char_length(m).cast("long"))
        # the k-th match ends after k + 1 gaps and k + 1 matches
        ends = running_sum(F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["found"])), sizes, lambda g, s: F.char_length(g) + s))

        def one(m: Column, k: Column, end: Column) -> Column:
            held = F.lit(None).cast("string")
            if before is not None:
                held = F.right(F.concat(F.when(k > 0, F.get(x["found"], k - 1)).otherwise(F.lit("")), F.get(x["gaps"], k)), F.lit(before))
            part = m if group is None else F.get(x["parts"], k)
            return F.struct((end - F.char_length(m)).alias("low"), end.alias("high"), m.alias("match"), part.alias("part"), held.alias("before"))

        return bound(ends, lambda e: F.transform(x["found"], lambda m, k: one(m, k, F.get(e, k))))

    full = bound(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps"), parts.alias("parts")), placed)
    return F.when(text.rlike(pattern), full).otherwise(F.array().cast("array<struct<low:bigint,high:bigint,match:string,part:string,before:string>>"))


def labelled(found: Column, kind: str, rank: int) -> Column:
    """Spans of a kind; rank orders kinds that start at the same place."""
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), x["low"].cast("long").alias("low"), x["high"].cast("long").alias("high")))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["low"].alias("low"), x["rank"].alias("rank"), x["high"].alias("high"), x["kind"].alias("kind"))))
    return F.concat_ws(",", F.transform(order, lambda x: F.concat_ws(":", x["kind"], x["low"].cast("string"), x["high"].cast("string"))))
