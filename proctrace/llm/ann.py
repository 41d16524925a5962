"""Nearest neighbours by inner product: inverted file with product-quantised residuals, settled by bounds.

Fit (bounded): the ``sample`` distinct vectors of least hash go to the driver, sample * dimension
numbers, for the coarse centroids and the codebooks of residuals; there are as many lists as the
square root of the distinct vectors, at most ``most_lists``. Everything else is Spark: every distinct
vector is assigned to its nearest centroid's list and encoded. The code is of the residual's direction,
its length is kept beside it, so near copies and far outliers are coded as closely, in proportion, as
others; and the code's error, the distance between vector and decoded vector, is kept too.

No inner product differs from that with the decoded vector by more than the error times the query's
length. So what is found is exact, on any rows: a query goes to each list that can hold one of its k
nearest (by the distance of the list's farthest entry from the centroid, against the k-th best of ``seeds``
fitted vectors), and each entry whose bound reaches the k-th best lower bound is joined with its vector
by id and scored in double precision. Up to there, rows of the index carry codes and ids only. Queries for
which more than ``rerank`` entries are left (ties, or codes that don't tell entries apart) are held against all
vectors, in blocks. With a number for ``share`` a query goes to that share of the lists alone, and to more
while these hold fewer than ``rerank`` entries; what is found is then approximate, by the lists left out.

Lists are packed into shelves of at most ``list_block`` entries, a list of more is dealt to several,
and a query goes once to each shelf that holds lists of its own; a task takes one shelf and one block
of queries.

Copies of a vector are one entry with its smallest k + 1 ids (more can't be among
the k nearest), and equal queries are searched once.

Defined cases: null, empty and zero vectors, and those with null or non-finite components, take
no part, neither do vectors without an id or of another length than most; fewer than k
candidates: all of them; ties go to the smaller id; rows of equal id and vector count once;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proctrace.llm.common import stage


def _nearest(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[k : k + block] @ centres.T - half, axis=1) for k in range(0, len(x), block)]) if len(x) else np.zeros(0, int)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """At most k centres of x; a centre that lost its points takes the farthest point of a large cluster."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if not full.all():
            far = np.argsort(((x - centres[near]) ** 2).sum(1))[::-1][: int((~full).sum())]
            centres[~full] = x[far]
    return centres


def levels(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k-means of numbers: at most k levels in order, from quantiles on."""
    x = np.sort(x)
    sums = np.concatenate([[0.0], np.cumsum(x)])
    out = np.unique(np.quantile(x, (np.arange(k) + 0.5) / k))
    for _ in range(rounds):
        edges = np.concatenate([[0], np.searchsorted(x, (out[1:] + out[:-1]) / 2), [len(x)]])
        full = np.diff(edges) > 0
        out[full] = np.diff(sums[edges])[full] / np.diff(edges)[full]
    return np.unique(out)


#: Over what rounding adds to a sum of products, in parts of the vectors' lengths.
ROUNDING = 1e-12


class Index:
    """Coarse centroids and codebooks; small enough to go to every task."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, codes: int, seed: int = 11):
        self.coarse = kmeans(sample, lists, 12, seed)
        units, _ = self._residuals(sample, _nearest(sample, self.coarse))
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(parts, sample.shape[1]))
        self.books = [levels(units[:, c[0]], codes, 8)[:, None] if len(c) == 1 else kmeans(units[:, c], codes, 8, seed + 1) for c in self.cuts]

    def _residuals(self, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Directions and lengths."""
        residuals = x - self.coarse[near]
        lengths = np.linalg.norm(residuals, axis=1)
        return residuals / np.where(lengths > 0, lengths, 1)[:, None], lengths

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes, lengths of residuals, and bounds of the codes' errors."""
        near = _nearest(x, self.coarse)
        units, lengths = self._residuals(x, near)
        put = lambda v, b: np.searchsorted((b[1:, 0] + b[:-1, 0]) / 2, v[:, 0]) if b.shape[1] == 1 else _nearest(v, b)
        code = np.stack([put(units[:, c], b) for c, b in zip(self.cuts, self.books)], axis=1).astype(np.uint8)
        error = np.linalg.norm(x - self.decode(near, code, lengths), axis=1) + ROUNDING * (np.linalg.norm(x, axis=1) + np.linalg.norm(self.coarse[near], axis=1))
        return near, code, lengths, np.nan_to_num(error, nan=np.inf)

    def decode(self, near: np.ndarray, code: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.empty((len(code), self.coarse.shape[1]))
        for m, (c, b) in enumerate(zip(self.cuts, self.books)):
            out[:, c] = b[code[:, m]]
        return self.coarse[near] + lengths[:, None] * out

    def probes(self, q: np.ndarray, share: float, held: np.ndarray, least: int) -> np.ndarray:
        """Which lists each query goes to; ``held`` are the lists' entries, at least ``least`` of which it meets."""
        order = np.argsort(-(q @ self.coarse.T), axis=1, kind="stable")
        before = np.cumsum(held[order], axis=1) - held[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, (np.arange(order.shape[1]) < share * order.shape[1]) | (before < least), axis=1)
        return out

    def reached(self, q: np.ndarray, radius: np.ndarray, seeds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Which lists can hold one of the k best of each query, and what these score at least."""
        size = np.linalg.norm(q, axis=1)
        least = np.full(len(q), -np.inf)
        if len(seeds) >= k:
            least = np.partition(q @ seeds.T, len(seeds) - k, axis=1)[:, len(seeds) - k] - ROUNDING * size * np.linalg.norm(seeds, axis=1).max()
            least = np.nan_to_num(least, nan=-np.inf, posinf=-np.inf)
        most = q @ self.coarse.T + size[:, None] * radius
        return ~(most < least[:, None]), least


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each column; minus infinity where there are fewer."""
    return np.partition(x, len(x) - k, axis=0)[len(x) - k] if len(x) >= k else np.full(x.shape[1], -np.inf)


def shelves(held: dict[int, int], block: int) -> list[tuple[int, int, int]]:
    """(list, first shelf, shelves it is dealt to): neighbouring lists share a shelf while they fit."""
    out, shelf, room = [], -1, 0
    for of, n in sorted(held.items()):
        if n > block:
            pieces = -(-n // block)
            out.append((of, shelf + 1, pieces))
            shelf, room = shelf + pieces, 0
            continue
        if n > room:
            shelf, room = shelf + 1, block
        out.append((of, shelf, 1))
        room -= n
    return out


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def search(vectors: DataFrame, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, sample: int = 20_000, most_lists: int = 1_024, share: float | None = None, parts: int | None = None, codes: int = 256, rerank: int = 512, seeds: int = 20_000, list_block: int = 65_536, query_block: int = 2_048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row for which ``queries``, a condition on vec_id, holds.

    parts: how many the codes have; by default as many as the vectors have components.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")).where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    dims = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    # copies: one entry with its smallest ids; the group limit works before the shuffle
    copies = W.partitionBy("key", "vec").orderBy("vec_id")
    rows = rows.where(F.size("vec") == dims[0]["dim"]).withColumn("key", F.xxhash64("vec"))
    first = rows.withColumn("no", F.dense_rank().over(copies)).where(F.col("no") <= k + 1)
    entries = stage(first.groupBy("key", "vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "ann-entries")
    asked = stage(rows.where(queries).select(F.col("vec_id").alias("query_id"), "key", "vec").distinct(), "ann-queries")

    searched = stage(asked.groupBy("key", "vec").agg(F.min("query_id").alias("qid")).withColumnRenamed("key", "qkey"), "ann-searched")

    n, dim = entries.count(), dims[0]["dim"]
    drawn = entries.select("key", "vec").orderBy("key").limit(sample).toPandas()
    fitted = np.array(drawn["vec"].tolist()).reshape(len(drawn), dim)
    index = Index(fitted, max(1, min(most_lists, round(n**0.5))), parts or dim, codes)
    # what a task holds at once: 32 MB of decoded vectors, and as much of the fitted ones
    list_block = max(1, min(list_block, (1 << 22) // dim))
    fitted = fitted[: min(seeds, max(1, (1 << 22) // dim))]
    rerank, wanted = max(rerank, k + 1), k + 1

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near, code, lengths, error = index.encode(np.array(b["vec"].tolist()))
                yield pd.DataFrame({"list": near, "code": [c.tobytes() for c in code], "length": lengths, "error": error, "key": b["key"], "least": b["least"]})

    least = entries.select("key", F.col("ids")[0].alias("least"), "vec")
    encoded = stage(least.mapInPandas(encode, "list int, code binary, length double, error double, key long, least long"), "ann-index")

    # as many rows as there are lists; from here on entries are codes and ids
    held = {r["list"]: r for r in encoded.groupBy("list").agg(F.count("*").alias("n"), F.max(F.col("length") + F.col("error")).alias("radius")).collect()}
    sizes = np.array([held[i]["n"] if i in held else 0 for i in range(len(index.coarse))])
    radius = np.array([held[i]["radius"] if i in held else 0.0 for i in range(len(index.coarse))])
    places = shelves({i: r["n"] for i, r in held.items()}, list_block)
    by_shelf: dict[int, list[int]] = {}
    for of, first_shelf, pieces in places:
        for p in range(pieces):
            by_shelf.setdefault(first_shelf + p, []).append(of)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.iloc[at : at + 256]
                q = np.array(b["vec"].tolist())
                asks, floor = index.reached(q, radius, fitted, wanted)
                if share is not None:
                    asks = index.probes(q, share, sizes, rerank)
                    floor[:] = -np.inf
                raw = [v.tobytes() for v in q]
                for shelf, of in by_shelf.items():
                    who = np.flatnonzero(asks[:, of].any(axis=1))
                    if len(who):
                        lists_of = [[of[j] for j in np.flatnonzero(a)] for a in asks[np.ix_(who, of)]]
                        yield pd.DataFrame({"shelf": shelf, "qkey": b["qkey"].to_numpy()[who], "qid": b["qid"].to_numpy()[who], "qvec": [raw[i] for i in who], "floor": floor[who], "lists": lists_of})

    # blocks of queries: of bounded size, and enough for all tasks while each has some queries
    asking, tasks = searched.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    queries_by = max(1, -(-asking // query_block), min(tasks, asking // 64))
    shelf_of = F.broadcast(vectors.sparkSession.createDataFrame(places, "list int, first int, pieces int"))
    items = encoded.join(shelf_of, "list").withColumn("shelf", F.col("first") + F.pmod(F.xxhash64("key", "least"), F.col("pieces")).cast("int"))
    items = items.select("shelf", F.explode(F.sequence(F.lit(0), F.lit(queries_by - 1))).alias("j"), "list", "code", "length", "error", "key", "least")
    wants = searched.mapInPandas(probe, "shelf int, qkey long, qid long, qvec binary, floor double, lists array<int>").withColumn("j", F.pmod(F.xxhash64("qkey", "qid"), F.lit(queries_by)).cast("int"))

    def rank(some: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        """Entries whose bounds reach the k-th best lower bound; one row without an entry for a query that has too many."""
        columns = ["qkey", "qid", "key", "least", "low", "high"]
        if not len(some) or not len(qs):
            return pd.DataFrame({c: [] for c in columns})
        some = some.sort_values(["list", "least", "key"], kind="stable")
        of, keys, ids, error = (some[c].to_numpy() for c in ("list", "key", "least", "error"))
        decoded = index.decode(of, np.frombuffer(b"".join(some["code"]), np.uint8).reshape(len(some), -1), some["length"].to_numpy())
        here, starts = np.unique(of, return_index=True)
        ends = [*starts[1:], len(some)]
        qs = qs.sort_values(["qid", "qkey"], kind="stable")
        out = []
        step = max(1, min(256, (1 << 21) // len(some)))
        for at in range(0, len(qs), step):
            part = qs.iloc[at : at + step]
            q = np.frombuffer(b"".join(part["qvec"]), float).reshape(len(part), -1)
            asks = np.zeros((len(q), len(here)), bool)
            for j, lists_of in enumerate(part["lists"]):
                asks[j, np.flatnonzero(np.isin(here, lists_of))] = True
            near = np.full((len(some), len(q)), -np.inf)
            for x, (lo, hi) in enumerate(zip(starts, ends)):
                who = np.flatnonzero(asks[:, x])
                if len(who):
                    near[lo:hi, who] = decoded[lo:hi] @ q[who].T
            slack = error[:, None] * np.linalg.norm(q, axis=1)
            low, high = np.nan_to_num(near - slack, nan=-np.inf), near + slack
            # what overflows can't be left out
            high[np.isnan(high) & np.repeat(asks.T, np.diff([*starts, len(some)]), axis=0)] = np.inf
            floor = np.maximum(part["floor"].to_numpy(), _kth(low, wanted))
            keep = (high >= floor) & (high > -np.inf)
            many = keep.sum(axis=0) > rerank
            keep[:, many] = False
            i, j = np.nonzero(keep)
            out.append(pd.DataFrame({"qkey": part["qkey"].to_numpy()[j], "qid": part["qid"].to_numpy()[j], "key": keys[i], "least": ids[i], "low": low[i, j], "high": high[i, j]}))
            if many.any():
                out.append(pd.DataFrame({"qkey": part["qkey"].to_numpy()[many], "qid": part["qid"].to_numpy()[many], "key": 0, "least": None, "low": -np.inf, "high": np.inf}))
        return pd.concat(out).astype({"least": "Int64"})

    by = ["shelf", "j"]
    found = items.groupBy(*by).cogroup(wants.groupBy(*by)).applyInPandas(rank, "qkey long, qid long, key long, least long, low double, high double")
    query = W.partitionBy("qkey", "qid")
    found = found.withColumn("no", F.row_number().over(query.orderBy(F.desc("low"))))
    found = found.withColumn("floor", F.max(F.when(F.col("no") == wanted, F.col("low"))).over(query)).where("floor is null or high >= floor or least is null")
    counted = found.withColumn("many", (F.count("*").over(query) > rerank) | F.max(F.col("least").isNull()).over(query))
    counted = stage(counted.select("qkey", "qid", "key", "least", "many"), "ann-found")
    found = counted.where("not many")
    rest = stage(counted.where("many").select("qkey", "qid").distinct().join(searched, ["qkey", "qid"]), "ann-rest")

    # exact scores: vectors are fetched by id
    product = F.aggregate(F.zip_with("qvec", "vec", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    exact = found.join(entries.withColumn("least", F.col("ids")[0]), ["key", "least"]).select("qkey", "qid", "ids", "vec")
    exact = exact.join(searched.withColumnRenamed("vec", "qvec"), ["qkey", "qid"]).select("qkey", "qid", F.explode("ids").alias("vec_id"), product.alias("score"))
    if not rest.isEmpty():
        exact = exact.unionByName(_against_all(rest, entries, wanted, n, list_block, query_block))
    best = exact.withColumn("no", F.row_number().over(query.orderBy(F.desc("score"), "vec_id"))).where(F.col("no") <= k + 1)
    best = best.groupBy("qkey", "qid").agg(F.array_sort(F.collect_list(F.struct("no", "vec_id", "score"))).alias("near"))
    best = stage(best.join(searched, ["qkey", "qid"]), "ann-best")
    own = asked.join(best.withColumnRenamed("vec", "qvec"), (asked["key"] == best["qkey"]) & (asked["vec"] == F.col("qvec")))
    own = own.select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _against_all(asked: DataFrame, entries: DataFrame, wanted: int, n: int, list_block: int, query_block: int) -> DataFrame:
    """(qkey, qid, vec_id, score): the best entries of each query and each block of vectors, scored in the order of components."""
    pieces, queries_by = -(-n // list_block), -(-asked.count() // query_block)
    items = entries.select(F.pmod(F.xxhash64("key", "vec"), F.lit(pieces)).cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), F.lit(queries_by - 1))).alias("j"), "ids", "vec")
    wants = asked.select(F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"), F.pmod(F.xxhash64("qkey", "qid"), F.lit(queries_by)).cast("int").alias("j"), "qkey", "qid", "vec")

    def rank(some: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(some) and len(qs):
            x, ids = np.array(some["vec"].tolist()), some["ids"].to_numpy()
            first, size = np.array([i[0] for i in ids]), np.linalg.norm(x, axis=1)
            for qkey, qid, vec in zip(qs["qkey"], qs["qid"], qs["vec"]):
                q = np.array(vec)
                near, slack = x @ q, ROUNDING * np.linalg.norm(q) * size
                close = np.flatnonzero(~(near + slack < _kth(np.nan_to_num(near - slack, nan=-np.inf)[:, None], wanted)[0]))
                score = np.zeros(len(close))
                for c in range(len(q)):  # as Spark sums
                    score += x[close, c] * q[c]
                best = np.lexsort((first[close], -score))[:wanted]
                out.append(pd.DataFrame({"qkey": qkey, "qid": qid, "ids": list(ids[close[best]]), "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("qkey", "qid", "ids", "score")})

    by = ["piece", "j"]
    found = items.groupBy(*by).cogroup(wants.groupBy(*by)).applyInPandas(rank, "qkey long, qid long, ids array<long>, score double")
    return found.select("qkey", "qid", F.explode("ids").alias("vec_id"), "score")
