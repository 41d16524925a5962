"""Benchmark decontamination by exact windows of words.

A window is n consecutive words of a benchmark item, or all words of a shorter item. Document
windows are looked up in two steps. Any window of L words that a document holds covers one of
the document's word groups of length g = (L + 1) div 2 that start at a multiple of g; hashes of
these groups, one word in g, are looked up in a hash set of the items' groups. The documents
found are then scanned at every word, and whole windows are compared, so that a hit never
rests on a hash. The hash set and the windows are each broadcast if they have at most
``broadcast_rows`` rows and ``broadcast_bytes`` bytes of text, and joined by shuffle otherwise;
the rows of the result are the same.

Only DataFrame functions are used.

Defined cases: null or wordless texts have no words, no hits and are clean; items without an id,
or without words, are left out; equal items count each by its id; rows of equal id and text
have the same result, a row each; an empty table of documents or items gives an empty result or
clean documents; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proctrace.llm.common import ascii_lower, same_row, stage, text_key

#: Fixed by the contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _groups(words: Column, g: int, starts: Column) -> Column:
    # by element: slice() would copy the whole array for each group
    return F.transform(starts, lambda i: F.xxhash64(F.lit(g), *[F.get(words, i + (k - 1)) for k in range(g)]))


def _gram(words: Column, at: Column, width: int) -> Column:
    return F.concat_ws(" ", *[F.get(words, at + (k - 1)) for k in range(width)])


def _windows(words: Column, width: int) -> Column:
    return F.transform(_starts(F.size(words), width, 1), lambda i: F.struct((i - 1).alias("low"), _gram(words, i, width).alias("gram")))


def _starts(count: Column, width: int, step: int) -> Column:
    """1, 1 + step, ... as far as width words fit; count: how many words there are."""
    return F.when(count >= width, F.sequence(F.lit(1), count - width + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _sent(df: DataFrame, size: Column, rows: int, most: int) -> DataFrame:
    """df, to be broadcast if it has at most that many rows and bytes."""
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= rows and found["bytes"] <= most else df


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = 13, share: int = 20, broadcast_rows: int = 1_000_000, broadcast_bytes: int = 128 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated, spans), a row per document.

    spans: the hit runs as (first word, end), from 0. A document is contaminated if it has hits
    and share * n_hit >= n_words.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), item_words(F.col(item_text_col)).alias("words")).where("item_id is not null and size(words) > 0")
    width = F.least(F.lit(n), F.size("words"))
    windows = items.select("item_id", width.alias("width"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - width + 1)).alias("at"))
    windows = stage(windows.select("item_id", "width", F.concat_ws(" ", F.slice("words", F.col("at"), F.col("width"))).alias("gram")).distinct(), "decon-windows")
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())  # n values at most
    sent = _sent(windows, F.octet_length("gram") + F.octet_length("item_id"), broadcast_rows, broadcast_bytes)

    # a window's groups that a document's grid can meet start at its first g words
    by_group = {g: [w for w in widths if (w + 1) // 2 == g] for g in {(w + 1) // 2 for w in widths}}
    probes = None
    for g, of in by_group.items():
        words = F.split("gram", " ")
        one = windows.where(F.col("width").isin(of)).select(F.explode(_groups(words, g, F.sequence(F.lit(1), F.lit(g)))).alias("probe"))
        probes = one if probes is None else probes.unionByName(one)

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key"))
    tokens = base.select("doc_id", "text_key", item_words(F.col("text")).alias("words"))
    count = F.size("words")
    grid = F.concat(*[_groups(F.col("words"), g, _starts(count, g, g)) for g in by_group]) if by_group else F.array().cast("array<bigint>")
    scan = stage(tokens.select("doc_id", "text_key", count.cast("long").alias("n_words"), grid.alias("grid")), "decon-scan")
    if probes is None:
        none = scan.where("false").select("doc_id", "text_key", F.lit(None).cast("array<struct<low:int,high:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
        spans = stage(none, "decon-none")
    else:
        probes = _sent(stage(probes.distinct(), "decon-probes"), F.lit(8), broadcast_rows, broadcast_bytes)
        found = scan.select("doc_id", "text_key", F.explode("grid").alias("probe")).join(probes, "probe", "left_semi").select("doc_id", "text_key").distinct()
        found = stage(found, "decon-found")
        held = base.join(found, same_row(base, found), "left_semi").dropDuplicates(["doc_id", "text_key"])
        # split once: the words are needed for every position
        held = stage(held.select("doc_id", "text_key", item_words(F.col("text")).alias("words")), "decon-held")
        hits = None
        for w in widths:
            at = _windows(F.col("words"), w)
            one = held.select("doc_id", "text_key", F.explode(at).alias("x")).select("doc_id", "text_key", F.col("x.low").alias("low"), (F.col("x.low") + w).alias("high"), F.col("x.gram").alias("gram"), F.lit(w).alias("width"))
            hits = one if hits is None else hits.unionByName(one)
        hits = hits.join(sent, ["width", "gram"])
        spans = hits.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["high"] - F.greatest(acc["end"], x["low"]))).alias("n"), F.greatest(acc["end"], x["high"]).alias("end"))
    spans = spans.withColumn("n_hit", F.aggregate("spans", start, step, lambda acc: acc["n"]))
    out = scan.drop("grid").join(spans, same_row(scan, spans), "left").select(scan["doc_id"], scan["text_key"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<low:int,high:int>>")).alias("spans"))
    return out.select("doc_id", "text_key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans")


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that aren't contaminated, all their columns as they were."""
    found = decontaminate(docs, benchmark, id_col=id_col, text_col=text_col, **options).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["__id"]) & (text_key(docs[text_col]) == found["__key"]), "left_anti")
