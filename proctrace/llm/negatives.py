"""Hard negatives by Fagin's threshold algorithm.

Components are whole numbers (floor of 256 times the original), scores integer inner products. Rows
are dealt by id to shards of bounded size; a shard's index holds its vectors and, for each
dimension, its rows in the order of that component. An anchor goes through these lists at the same
depth in all, from their upper end where its own component is positive and from their lower end
where it is negative; each row met is scored at once on its whole vector (random access). What
hasn't been met scores no more than the threshold, the anchor's product with the components
reached. Going on stops for a search when the threshold is strictly below the score of the last row
that it wants, so that ties are complete, or below anything it may take.

A first pass finds each anchor's positives, a second the negatives of each positive's window of
scores; both merge what the shards give. Anchors come in blocks: (shard, block) is a group of its own.

Defined cases: rows without an id, label or vector, or with null or non-finite components, take no
part, neither do vectors of another length than most; zero vectors do. Rows alike in id, label and
vector count once; an anchor's candidates are rows of other ids. No positives: no rows; fewer than
wanted: all of them. An empty table gives an empty result; other columns are not read. Scores
beyond 64 bits aren't supported.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proctrace.llm.common import discard, stage

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
FOUND = "key long, no int, vec_id long, score long"


class Shard:
    """Vectors and their sorted lists. met: how many rows the searches have scored so far."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, order: np.ndarray):
        self.ids, self.labels, self.order, self.met = ids, labels, order, 0
        self.sorted = np.take_along_axis(vectors.T, order, axis=1)
        top = int(np.abs(vectors).max(initial=0))
        # sums of doubles are exact up to 2 ** 53
        self.exact = np.float64 if top * top * max(1, vectors.shape[1]) < 1 << 53 else np.int64
        self.vectors = vectors.astype(self.exact)

    def search(self, anchor: np.ndarray, searches: list[Search], first: int = 32) -> None:
        """Feeds rows to the searches until each has what it wants."""
        n = len(self.ids)
        up, down = anchor > 0, anchor < 0
        a = anchor.astype(self.exact if np.abs(anchor).max(initial=0) < 1 << 26 else np.int64)
        seen, depth, before = np.zeros(n, bool), min(first, n), 0
        while True:
            fresh = np.zeros(n, bool)
            fresh[self.order[down, before:depth].ravel()] = True
            fresh[self.order[up, n - depth : n - before].ravel()] = True
            if not (up.any() or down.any()):
                fresh[before:depth] = True
            rows = np.flatnonzero(fresh & ~seen)
            seen |= fresh
            self.met += len(rows)
            score = (self.vectors[rows] @ a).astype(np.int64)
            limit = int(anchor[up] @ self.sorted[up, n - depth]) + int(anchor[down] @ self.sorted[down, depth - 1])
            done = [s.add(self.ids[rows], self.labels[rows], score, limit) for s in searches]
            if all(done) or depth == n:
                return
            before, depth = depth, min(2 * depth, n)


class Search:
    """The k best rows that it takes, ties by smaller id."""

    def __init__(self, k: int, takes: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], least: int | None = None):
        self.k, self.takes, self.least = k, takes, least
        self.ids, self.scores, self.done = np.zeros(0, np.int64), np.zeros(0, np.int64), False

    def add(self, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, limit: int) -> bool:
        if not self.done:
            own = self.takes(ids, labels, scores)
            ids, scores = np.concatenate((self.ids, ids[own])), np.concatenate((self.scores, scores[own]))
            best = np.lexsort((ids, -scores))[: self.k]
            self.ids, self.scores = ids[best], scores[best]
            self.done = (len(best) == self.k and limit < self.scores[-1]) or (self.least is not None and limit < self.least)
        return self.done


def whole_numbers(vec: Column) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True))


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, ids, labels, vectors, orders), staged; the last two are packed matrices of 64 and 32 bits."""

    def build(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        vectors = np.array(some["vec"].tolist(), np.int64).reshape(len(some), -1)
        order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
        return pd.DataFrame({"shard": [key[0]], "ids": [some["vec_id"].to_numpy()], "labels": [some["label"].to_numpy()], "vectors": [vectors.tobytes()], "orders": [order.tobytes()]})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(shards)).cast("int"))
    return stage(dealt.groupBy("shard").applyInPandas(build, "shard int, ids array<long>, labels array<long>, vectors binary, orders binary"), "neg-index")


def _searched(index: DataFrame, shards: int, anchors: DataFrame, blocks: int, searches: Callable[[object], list[tuple[int, Search]]]) -> DataFrame:
    """(key, no, vec_id, score): what each anchor's searches find in each shard. searches: from an anchor's row to numbered ones."""

    def go(lists: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(lists) and len(some):
            one = lists.iloc[0]
            n = len(one["ids"])
            vectors = np.frombuffer(one["vectors"], np.int64).reshape(n, -1)
            shard = Shard(np.asarray(one["ids"], np.int64), np.asarray(one["labels"], np.int64), vectors, np.frombuffer(one["orders"], np.int32).reshape(-1, n))
            for row in some.itertuples(index=False):
                own = searches(row)
                shard.search(np.asarray(row.vec, np.int64), [s for _, s in own])
                out += [(row.key, no, i, x) for no, s in own for i, x in zip(s.ids.tolist(), s.scores.tolist())]
        return pd.DataFrame(out, columns=["key", "no", "vec_id", "score"])

    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    lists = index.select("*", every(blocks, "block"))
    wants = anchors.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int")).select("*", every(shards, "shard"))
    by = ["shard", "block"]
    return lists.groupBy(*by).cogroup(wants.groupBy(*by)).applyInPandas(go, FOUND)


def mine(vectors: DataFrame, anchors: Column, *, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, shard_rows: int = 4096, block_anchors: int = 1024, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """For each anchor (a condition on vec_id and label) and positive the first different-label rows whose score is low to high percent of the positive's."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec"))).select("vec_id", "label", whole_numbers(F.col("vec")).alias("vec"))
    dims = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not dims:
        return spark.createDataFrame([], RESULT)
    rows = stage(rows.where(F.size("vec") == dims[0]["dim"]).distinct(), "neg-rows")
    asked = stage(rows.where(anchors).withColumn("key", F.xxhash64("vec_id", "label", "vec")), "neg-anchors")
    shards, blocks = -(-rows.count() // shard_rows), -(-asked.count() // block_anchors) or 1
    index = build_index(rows, shards)
    discard(rows)

    def alike(row) -> list[tuple[int, Search]]:
        return [(0, Search(n_positives, lambda ids, labels, _: (labels == row.label) & (ids != row.vec_id)))]

    def window(row, score: int) -> Search:
        fits = lambda ids, labels, s: (labels != row.label) & (ids != row.vec_id) & (low * score <= 100 * s) & (100 * s <= high * score)
        return Search(n_negatives, fits, least=-(-low * score // 100))

    def apart(row) -> list[tuple[int, Search]]:
        return [(int(p["no"]), window(row, int(p["score"]))) for p in row.positives]

    best = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    near = _searched(index, shards, asked, blocks, alike).withColumn("no", best("key")).where(F.col("no") <= n_positives)
    positives = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", "vec_id", "score"))).alias("positives"))
    windows = stage(asked.join(positives, "key"), "neg-windows")
    found = _searched(index, shards, windows, blocks, apart).withColumn("rank", best("key", "no")).where(F.col("rank") <= n_negatives)
    found = found.select("key", "no", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    flat = windows.select("key", F.col("vec_id").alias("anchor_id"), F.explode("positives").alias("p")).select("key", "anchor_id", F.col("p.no").alias("no"), F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    out = stage(flat.join(found, ["key", "no"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "neg-found")
    discard(index, asked, windows)
    return out
