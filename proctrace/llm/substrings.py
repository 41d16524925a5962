"""Removal of repeated byte strings by prefix-free parsing.

A byte is removed if a string of ``length`` bytes that covers it also starts in a document of
smaller id. Triggers of a rolling hash cut each text into phrases: in every window of
length bytes the leftmost ``gram``-byte string of least hash is the trigger, so the window's own
content decides which; the windows with the same trigger, one after the other, form a phrase
(about one for every 14 bytes). Repetition is then settled on three tables:

- triggers that occur in more than one document (counted before they are shuffled);
- the dictionary: each distinct phrase around such a trigger, with the smallest id it occurs in.
  The parse, the phrases' occurrences, is joined with it: an occurrence in a larger id is
  repeated whole. So copied passages and documents cost a row for a phrase, not for a byte;
- where one trigger has several phrases, at the ends of copied stretches, the windows of each
  dictionary phrase, taken from its first document, are put in order over the corpus, and
  those found in a smaller id are repeated.

The corpus order of dictionary windows comes from a shuffle on their hashes in place of suffix
arrays merged over dictionary and parse: only equality of windows is asked for, and no task
needs more than its share. Strings are compared by 64-bit hashes.

Defined cases: a null text is empty; documents shorter than length keep all; a null id has no
smaller or larger id, so nothing is removed from it or because of it; rows of one id don't remove
each other's bytes; repeated rows have the same result, a row each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proctrace.llm.bytes import binaries, mix, prefix_hashes, spans_hash
from proctrace.llm.common import discard, stage


def parse(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each phrase: the hash of its trigger, its own hash, the first start and the number of its windows."""
    data = np.frombuffer(text, np.uint8)
    n = len(data) - length + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    p = prefix_hashes(data)
    at = np.arange(len(data) - gram + 1)
    hashes = spans_hash(p, at, at + gram)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: n], least[width - span : width - span + n])
    owner = (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    count = np.diff(np.append(first, n))
    trigger = owner[first]
    phrase = mix(spans_hash(p, first, first + count - 1 + length) + (trigger - first).astype(np.uint64))
    return hashes[trigger].view(np.int64), phrase.view(np.int64), first, count


def _batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of batches with texts of about most bytes, so that arrays stay small."""
    for batch in batches:
        sizes, at, held = [len(x) if x is not None else 0 for x in batch["text"].cast(pa.large_binary()).to_pylist()], 0, 0
        for i, s in enumerate(sizes):
            held += s
            if held >= most or i + 1 == len(sizes):
                yield batch.slice(at, i + 1 - at)
                at, held = i + 1, 0


def _repeat(column: pa.Array, counts: list[int]) -> np.ndarray:
    return np.repeat(column.to_numpy(zero_copy_only=False), counts)


def repeated_spans(docs: DataFrame, *, length: int = 50, gram: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, spans): the runs that are repeated, unmerged, as low * 2**31 + high, for documents that have any."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text_col).alias("text_key"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))

    def triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches):
            found = [np.unique(parse(t, length, gram)[0]) for t in binaries(part["text"])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(_repeat(part["doc_id"], [len(x) for x in found]))], names=["trigger", "doc_id"])

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches):
            found = [parse(t, length, gram) for t in binaries(part["text"])]
            counts = [len(x[0]) for x in found]
            trigger, phrase, first, count = (np.concatenate([x[k] for x in found]) for k in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(trigger), pa.array(phrase), pa.array(_repeat(part["doc_id"], counts)), pa.array(_repeat(part["text_key"], counts).astype(np.int32)), pa.array(first * 256 + count)], names=["trigger", "phrase", "doc_id", "text_key", "place"])

    seen = base.mapInArrow(triggers, "trigger long, doc_id long")
    shared = stage(seen.groupBy("trigger").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("trigger"), "pfp-triggers")
    parsed = base.mapInArrow(phrases, "trigger long, phrase long, doc_id long, text_key int, place long")
    live = stage(parsed.join(shared.hint("shuffle_hash"), "trigger"), "pfp-parse")
    entries = stage(live.groupBy("trigger", "phrase").agg(F.min("doc_id").alias("first_id")), "pfp-dictionary")

    discard(shared)
    # phrases that an earlier document has go whole; of those new in their document, the ones that
    # share their trigger with other phrases are looked at window by window
    several = stage(entries.groupBy("trigger").agg(F.count("*").alias("n")).where("n > 1").select("trigger", F.lit(True).alias("several")), "pfp-several")
    known = stage(entries.join(several, "trigger", "left").select("phrase", "first_id", "several"), "pfp-known")
    start, count = F.floor(F.col("place") / 256), F.col("place") % 256
    span = lambda low, high: (low * (1 << 31) + high).cast("long").alias("span")
    marked = live.join(known, "phrase").where("first_id < doc_id or several").select("doc_id", "text_key", "place", (F.col("first_id") < F.col("doc_id")).alias("old"))
    marked = stage(marked, "pfp-marked")
    discard(live, entries, several, known)
    whole = marked.where("old").select("doc_id", "text_key", span(start, start + count - 1 + length))
    edges = stage(marked.where("not old").groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places")), "pfp-edges")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches):
            hashes, starts, counts = [], [], []
            for t, places in zip(binaries(part["text"]), part["places"]):
                place = places.values.to_numpy()
                n = place % 256
                at = np.repeat(place // 256, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hashes.append(spans_hash(prefix_hashes(np.frombuffer(t, np.uint8)), at, at + length).view(np.int64))
                starts.append(at)
                counts.append(len(at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(_repeat(part["doc_id"], counts)), pa.array(_repeat(part["text_key"], counts).astype(np.int32)), pa.array(np.concatenate(starts).astype(np.int64))], names=["window", "doc_id", "text_key", "start"])

    texts = base.join(edges, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    grams = stage(texts.select("text", "doc_id", "text_key", "places").mapInArrow(windows, "window long, doc_id long, text_key int, start long"), "pfp-windows")
    earliest = stage(grams.groupBy("window").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").drop("last_id"), "pfp-order")
    partial = grams.join(earliest, "window").where("first_id < doc_id").select("doc_id", "text_key", span(F.col("start"), F.col("start") + length))
    return whole.unionByName(partial).groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("spans"))


def cut(data: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, int]:
    """Which bytes stay, and how many maximal runs go."""
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, spans >> 31, 1)
    np.add.at(edge, spans & ((1 << 31) - 1), -1)
    gone = np.cumsum(edge[:-1]) > 0
    return ~gone, int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) and, if asked for, kept, the remaining bytes; a row per document."""
    found = stage(repeated_spans(docs, id_col=id_col, text_col=text_col, **options), "pfp-spans")
    base = docs.select(F.col(id_col).alias("doc_id"), F.hash(text_col).alias("text_key"), F.col(text_col).alias("text"))
    both = base.join(found, (base["doc_id"] == found["doc_id"]) & (base["text_key"] == found["text_key"]), "left").select(base["doc_id"], "text", "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches):
            rows = []
            for t, spans in zip(binaries(part["text"]), part["spans"]):
                data, runs = np.frombuffer(t, np.uint8), 0
                if spans.is_valid:
                    stays, runs = cut(data, spans.values.to_numpy())
                    data = data[stays]
                rows.append((len(t), len(t) - len(data), runs, hashlib.sha256(data.tobytes()).hexdigest(), data.tobytes() if keep_bytes else None))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    id_type = base.schema["doc_id"].dataType.simpleString()
    out = both.mapInArrow(apply, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_bytes else out.drop("kept")
