"""Ranked lexical search: an index of blocks by shard, and Block-Max MaxScore over it.

``build_index`` goes through the documents once. Each task cuts what it reads into shards of
bounded size and emits, for each shard, its documents' ids and lengths, and for each term its
postings (document's place in the shard, occurrences) in compressed blocks; of each block its last
place, the most occurrences and the least length stay readable, which bound its scores whatever
the corpus's totals are.

``search`` joins the index with the items' terms (items are dealt to blocks of bounded number) and
goes through each shard for a block of items. Lists whose global bounds together can't reach the
score of the item's k-th document so far are non-essential: documents that occur in these alone are
never looked at. A document from the essential lists is rejected if it can't reach that score with
what the blocks at its place in the others can add; only the rest have blocks decompressed. The
shards' heaps are merged by a window.

Defined cases: null and empty texts have no terms: such documents are in no list, such items have
no result; repeated documents are ranked each; items of equal id and text are one, those of equal
id and unlike texts are ranked apart under the same id; equal scores go by ascending doc_id, null
last; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proctrace.llm.bytes import LOWER, binaries, prefix_hashes, spans_hash
from proctrace.llm.common import ascii_lower, discard, stage

#: Fixed by the contract.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

INDEX = "shard string, term string, df int, last array<int>, most array<int>, least array<int>, cuts array<int>, data binary, ids array<long>, n array<int>"
POSTING = np.dtype([("place", "<u4"), ("tf", "<u4")])
BLOCK = 128


def _counts(texts: list[bytes], at: int, words: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, tf) of each term of each text, places from at, and the texts' numbers of terms. words: gets each hash's term."""
    data = LOWER[np.frombuffer(b" ".join(texts), np.uint8)]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = INSIDE[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = spans_hash(prefix_hashes(data), start, end)
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    doc = np.searchsorted(begins, start, side="right") - 1
    order = np.lexsort((doc, hashes))
    h, d = hashes[order], doc[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))) if len(h) else np.zeros(0, int)
    tf = np.diff(np.concatenate((new, [len(h)])))
    raw = data.tobytes()
    firsts = new[np.concatenate(([True], h[new][1:] != h[new][:-1]))] if len(new) else new
    for k, i in zip(h[firsts].tolist(), order[firsts].tolist()):
        if k not in words:
            words[k] = raw[start[i] : end[i]]
    return h[new], d[new] + at, tf, np.bincount(doc, minlength=len(texts))


def _shard_rows(name: str, ids: list, parts: list[tuple], words: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: its documents, its short lists, its lists of several blocks."""
    h, place, tf = (np.concatenate([p[k] for p in parts]) for k in range(3))
    n = np.concatenate([p[3] for p in parts])
    schema = pa.schema([("shard", pa.string()), ("term", pa.string()), ("df", pa.int32()), *[(c, pa.list_(pa.int32())) for c in ("last", "most", "least", "cuts")], ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int32()))])
    none = {c: [None] for c in schema.names}
    yield pa.RecordBatch.from_pydict(none | {"shard": [name], "ids": [ids], "n": [n.tolist()]}, schema=schema)
    if not len(h):
        return
    order = np.lexsort((place, h))
    h, place, tf = h[order], place[order], tf[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    size = np.diff(np.concatenate((first, [len(h)])))
    packed = np.empty(len(h), POSTING)
    packed["place"], packed["tf"] = place, tf
    raw, length = packed.tobytes(), n[place]
    for few in (True, False):
        chosen = np.flatnonzero((size <= BLOCK) == few)
        if not len(chosen):
            continue
        at, k = first[chosen], size[chosen]
        blocks = -(-k // BLOCK)
        owner = np.repeat(np.arange(len(chosen)), blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        low = at[owner] + number * BLOCK
        high = np.minimum(low + BLOCK, (at + k)[owner])
        # the stretches between chosen lists fall into segments of their own, which are left out
        bounds = np.stack((low, high), axis=1).ravel()
        inner = np.minimum(bounds, len(h) - 1)
        most = np.maximum.reduceat(tf, inner)[::2]
        least = np.minimum.reduceat(length, inner)[::2]
        if bounds[-1] == len(h):  # the last segment ran to the end of its own accord
            most[-1], least[-1] = tf[low[-1] :].max(), length[low[-1] :].min()
        if few:
            pieces = [raw[8 * a : 8 * b] for a, b in zip(low.tolist(), high.tolist())]
            data, cuts = pieces, [[0, len(p)] for p in pieces]
        else:
            pack = zstandard.ZstdCompressor(level=1).compress
            pieces = [pack(np.ascontiguousarray(place[a:b]).astype("<u4").tobytes() + np.ascontiguousarray(tf[a:b]).astype("<u4").tobytes()) for a, b in zip(low.tolist(), high.tolist())]
            ends = np.cumsum(blocks)
            groups = [pieces[e - b : e] for e, b in zip(ends.tolist(), blocks.tolist())]
            data, cuts = [b"".join(g) for g in groups], [np.concatenate(([0], np.cumsum([len(p) for p in g]))).tolist() for g in groups]
        offsets = pa.array(np.concatenate(([0], np.cumsum(blocks))), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (place[high - 1], most, least)]
        terms = pa.array([words[x] for x in h[at].tolist()], pa.binary()).cast(pa.string())
        m = len(chosen)
        yield pa.RecordBatch.from_arrays([pa.array([name] * m), terms, pa.array(k, pa.int32()), *lists, pa.array(cuts, pa.list_(pa.int32())), pa.array(data, pa.binary()), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int32()))], schema=schema)


def build_index(docs: DataFrame, *, shard_docs: int = 16_384, shard_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The staged index: a row for each shard's documents (term null) and for each term of a shard."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, no = TaskContext.get().partitionId(), 0
        ids, parts, words, held, texts, waiting = [], [], {}, 0, [], 0

        def count() -> None:
            nonlocal texts, waiting
            if texts:
                parts.append(_counts(texts, len(ids) - len(texts), words))
            texts, waiting = [], 0

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), binaries(batch["text"])):
                ids.append(doc_id)
                texts.append(text)
                waiting, held = waiting + len(text), held + len(text)
                if waiting >= 1 << 20:
                    count()
                if len(ids) >= shard_docs or held >= shard_bytes:
                    count()
                    yield from _shard_rows(f"{task}-{no}", ids, parts, words)
                    ids, parts, words, held, no = [], [], {}, 0, no + 1
        count()
        if ids:
            yield from _shard_rows(f"{task}-{no}", ids, parts, words)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage(base.mapInArrow(build, INDEX), "rank-index")


class _List:
    """A term's postings in a shard. decoded: how many blocks were decompressed."""

    def __init__(self, row, m: np.ndarray):
        self.last, self.cuts, self.data, self.m, self.w = np.asarray(row.last), np.asarray(row.cuts), row.data, m, int(row.w)
        self.top = impact(np.asarray(row.most, np.int64), np.asarray(row.least, np.int64))
        self.single, self.known = row.df <= BLOCK, {}

    def bounds(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block at each place, and what it can add at most; 0 beyond the last."""
        block = np.searchsorted(self.last, places)
        return block, np.append(self.top, 0)[block]

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.known:
            piece = self.data[self.cuts[i] : self.cuts[i + 1]]
            if self.single:
                both = np.frombuffer(piece, POSTING)
                place, tf = both["place"].astype(np.int64), both["tf"].astype(np.int64)
            else:
                both = np.frombuffer(zstandard.ZstdDecompressor().decompress(piece), "<u4").astype(np.int64)
                place, tf = both[: len(both) // 2], both[len(both) // 2 :]
            self.known[i] = place, impact(tf, self.m[place])
        return self.known[i]


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def best_of_shard(lists: list[_List], weights: list[int], rank: np.ndarray, k: int, window: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best documents of a shard. rank: of each place, for ties."""
    found = [(w * int(x.top.max()), x, w) for x, w in zip(lists, weights) if w > 0]
    found.sort(key=lambda t: t[0])
    uppers = np.cumsum([t[0] for t in found])
    places, scores, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for a in range(0, len(rank), window):
        b = min(a + window, len(rank))
        split = int(np.searchsorted(uppers, floor)) if len(scores) == k else 0  # sums below the floor: non-essential
        sums = np.zeros(b - a, np.int64)
        for _, x, w in found[split:]:
            for i in range(int(np.searchsorted(x.last, a)), min(int(np.searchsorted(x.last, b - 1)), len(x.last) - 1) + 1):
                place, s = x.block(i)
                own = (place >= a) & (place < b)
                sums[place[own] - a] += w * s[own]
        some = np.flatnonzero(sums)
        score, some = sums[some], some + a
        if split and len(some):
            at = [x.bounds(some) for _, x, _ in found[:split]]
            rest = sum(w * top for (_, top), (_, _, w) in zip(at, found[:split]))
            alive = np.flatnonzero(score + rest >= floor)
            for (block, top), (_, x, w) in zip(at[::-1], found[:split][::-1]):
                if not len(alive):
                    break
                rest[alive] -= w * top[alive]
                for i in np.unique(block[alive]):
                    if i < len(x.last):
                        here = alive[block[alive] == i]
                        place, s = x.block(int(i))
                        spot = np.minimum(np.searchsorted(place, some[here]), len(place) - 1)
                        score[here] += np.where(place[spot] == some[here], w * s[spot], 0)
                alive = alive[score[alive] + rest[alive] >= floor]
            some, score = some[alive], score[alive]
        places, scores = np.concatenate((places, some)), np.concatenate((scores, score))
        best = np.lexsort((rank[places], -scores))[:k]
        places, scores = places[best], scores[best]
        floor = int(scores[-1]) if len(scores) == k else 0
    return places, scores


def search(index: DataFrame, items: DataFrame, *, k: int = 20, block_items: int = 64, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    totals = index.where("term is null").select(F.explode("n").alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    spark, schema = index.sparkSession, "item_id long, rank int, doc_id long, score long"
    if not totals["terms"]:
        return spark.createDataFrame([], schema)
    n_docs, n_terms = totals["docs"], totals["terms"]
    asked = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct()
    blocks = -(-asked.count() // block_items) or 1
    words = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(f"({TERM})"))
    words = asked.select("item_id", F.xxhash64("item_id", "text").alias("key"), F.explode(words).alias("term"))
    words = words.groupBy("item_id", "key", "term").agg(F.count("*").alias("times")).withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))
    # a term's items, at most those of a block
    wants = words.groupBy("block", "term").agg(F.collect_list(F.struct("item_id", "key", "times")).alias("wants"))
    lists = index.where("term is not null").select("shard", "term", "df", "last", "most", "least", "cuts", "data").join(wants.select("term").distinct(), "term", "left_semi")
    lists = stage(lists, "rank-lists")
    df = lists.groupBy("term").agg(F.sum("df").alias("total"))
    weights = df.select("term", F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.col("total") + 1))).alias("w")).where("w > 0")
    lists = lists.join(weights, "term").join(wants, "term")
    shards = index.where("term is null").select("shard", "ids", "n", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def rank(some: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(some):
            ids, n = docs["ids"].iloc[0], np.asarray(docs["n"].iloc[0], np.int64)
            ids = pd.array(ids, "Int64") if any(i is None or i != i for i in ids) else np.asarray(ids, np.int64)
            order = pd.Series(ids).rank(method="first", na_option="bottom").to_numpy()
            m = 75 + 25 * n * n_docs // n_terms
            by_item: dict = {}
            for row in some.itertuples(index=False):
                least = 75 + 25 * np.asarray(row.least, np.int64) * n_docs // n_terms
                one = _List(row._replace(least=least), m)
                for want in row.wants:
                    by_item.setdefault((want["item_id"], want["key"]), []).append((one, one.w * want["times"]))
            for (item, key), terms in by_item.items():
                places, scores = best_of_shard([t[0] for t in terms], [t[1] for t in terms], order, k)
                out += [(item, key, ids[p], s) for p, s in zip(places.tolist(), scores.tolist())]
        found = pd.DataFrame(out, columns=["item_id", "key", "doc_id", "score"])
        return found.astype({"item_id": "Int64", "key": "int64", "doc_id": "Int64", "score": "int64"})

    by = ["block", "shard"]
    heaps = lists.groupBy(*by).cogroup(shards.groupBy(*by)).applyInPandas(rank, "item_id long, key long, doc_id long, score long")
    best = W.partitionBy("item_id", "key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    index = build_index(docs)
    found = stage(search(index, items, k=k), "rank-found")
    discard(index)
    return found
