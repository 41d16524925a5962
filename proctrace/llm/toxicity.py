"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Fit, on the driver, from a bounded sample (``per_class`` labelled rows of each class, those of
least hash, with texts of at most ``longest`` bytes): part of it trains the dictionaries, the
rest calibrates. Both dictionaries begin with the same content, trained by zstandard on
ordinary windows, so what they share cancels out. The ordinary one goes on with ordinary
words, the toxic one with the terms of toxic text: words whose number of distinct preceding
words in toxic text is far above that in ordinary text (copies of a document, having one
context, don't count often). Each window of ``words`` words is compressed with both; how many
bytes the toxic dictionary saves, over all windows of the text, gives features for a
logistic calibration, weighted to the classes' shares among the labels.

All windows of every whole text are scored, in Arrow batches. Scores see the text alone.

Defined cases: a null text scores as an empty one, whose only feature is having no windows; rows
without a label in {0, 1}, or whose id has no label, take no part in the fit; a doubly
labelled id is toxic if any label says so; a null id is not held out; if the fit lacks a
class, every score is the share of label 1 among the labels, or 0 without labels; repeated rows
score alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE = b".,;:!?&*%#$\"'()[]"
STEPS = (2, 3, 4, 5, 6, 7, 8)
LABELS_FOLD = 5


def held_out(doc_id: Column) -> Column:
    """Rows that the fit never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % LABELS_FOLD == 0, F.lit(False))


class Model:
    """Two dictionaries and a calibration; a few kilobytes, sent to every task."""

    def __init__(self, toxic: list[str], ordinary: list[str], share: float, *, words: int = 6, level: int = 7, base_bytes: int = 3000, seed: int = 5):
        self.words, self.level, self.share, self.weights = words, level, share, None
        if not toxic or not ordinary:
            return
        cut = lambda x: (x[: len(x) // 2 + 1], x[len(x) // 2 + 1 :] or x)
        (fit_t, own_t), (fit_o, own_o) = cut(toxic), cut(ordinary)
        terms = self._terms(fit_t, fit_o)
        tail = b" " + b" ".join(terms) + b" "
        rng = np.random.default_rng(seed)
        pool = [w for t in fit_o for w in t.lower().encode().split()]
        rest = b" ".join(pool[i] for i in rng.integers(0, len(pool), 1 + len(tail) // 4)) if pool else b""
        base = self._trained([w for t in fit_o for w in self._windows(t)][:200_000], base_bytes)
        self.contents = base + tail, base + rest[: len(tail)]
        x = np.array([self.features(t) for t in own_t + own_o])
        y = np.repeat([1.0, 0.0], [len(own_t), len(own_o)])
        weight = np.repeat([share / len(own_t), (1 - share) / len(own_o)], [len(own_t), len(own_o)]) * len(y)
        self._calibrate(x, y, weight)

    @staticmethod
    def _contexts(texts: list[str]) -> Counter:
        pairs = set()
        for t in texts:
            ws = [w.strip(EDGE) for w in t.lower().encode().split()]
            pairs.update(zip([b"", *ws], ws))
        return Counter(w for _, w in pairs)

    def _terms(self, toxic: list[str], ordinary: list[str], most: int = 400, score: float = 4.0, least: int = 8) -> list[bytes]:
        """Terms of toxic text, the strongest last, where zstandard finds them at the shortest offsets."""
        t, o = self._contexts(toxic), self._contexts(ordinary)
        nt, no = max(1, sum(t.values())), max(1, sum(o.values()))
        least = min(least, max(2, len(toxic) // 20))

        def z(w: bytes) -> float:
            p = (t[w] + o[w]) / (nt + no)
            return (t[w] / nt - o[w] / no) / np.sqrt(p * (1 - p) * (1 / nt + 1 / no) + 1e-15)

        found = [(z(w), w) for w, n in t.items() if n >= least and len(w) > 1 and n / nt > 4 * o[w] / no]
        return [w for s, w in sorted(found)[-most:] if s > score]

    @staticmethod
    def _trained(samples: list[bytes], size: int) -> bytes:
        try:
            return zstandard.train_dictionary(size + 1024, samples).as_bytes()[-size:]
        except zstandard.ZstdError:  # too few samples to train on
            return b" ".join(samples)[-size:]

    def _windows(self, text: str) -> list[bytes]:
        ws, n = text.lower().encode().split(), self.words
        return [b" " + b" ".join(ws[i : i + n]) + b" " for i in range(0, len(ws), n)]

    def _compressors(self) -> list:
        if not hasattr(self, "_made"):
            self._made = []
            for content in self.contents:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._made.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        return self._made

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def features(self, text: str) -> list[float]:
        toxic, ordinary = self._compressors()
        windows = self._windows(text)
        if not windows:
            return [0.0] * (6 + len(STEPS))
        saved = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows], float)
        n = len(saved)
        top = np.sort(saved)[::-1]
        return [top[0], top[:2].mean(), top[:4].mean(), top[: max(1, n // 20)].mean(), saved.mean(), np.log1p(n), *[np.sqrt((saved >= s).mean()) for s in STEPS]]

    def _calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> None:
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-9
        a = np.c_[np.ones(len(x)), (x - self.centre) / self.scale]
        b = np.zeros(a.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            slope = a.T @ (weight * (p - y)) + ridge * b
            b -= np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(b)), slope)
        self.weights = b

    def score(self, text: str) -> float:
        if self.weights is None:
            return self.share
        z = self.weights[0] + ((np.array(self.features(text)) - self.centre) / self.scale) @ self.weights[1:]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2_500, longest: int = 65_536, **options) -> Model:
    marks = labels.select(F.col(id_col).alias("own_id"), F.col(label_col).alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("own_id").isNotNull())
    marks = marks.groupBy("own_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("own_id")))
    share = marks.agg(F.avg("toxic")).first()[0]
    chosen = None
    for label in (1, 0):
        one = marks.where(F.col("toxic") == label).orderBy(F.xxhash64("own_id"), "own_id").limit(per_class)
        chosen = one if chosen is None else chosen.unionByName(one)
    texts = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= longest)
    rows = texts.join(F.broadcast(chosen), "own_id").dropDuplicates(["own_id"]).collect()  # per_class texts of each class
    rows.sort(key=lambda r: (hash_order(r["own_id"]), r["own_id"]))
    return Model([r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0], float(share or 0.0), **options)


def hash_order(doc_id) -> int:
    """A fixed shuffle of ids for the halves of the sample."""
    return (int(doc_id) * 2654435761) % (1 << 32) if not isinstance(doc_id, str) else sum(map(ord, re.sub(r"\s", "", doc_id))) * 2654435761 % (1 << 32)


def score_texts(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) and the columns to keep, a row per document."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t or "") for t in texts], dtype="float64")

    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), scored(F.col(text_col)).alias("score"), *keep)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *keep)


def without_toxic(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The documents that the model doesn't reject, all their columns as they were."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t or "") for t in texts], dtype="float64")

    return docs.where(scored(F.col(text_col)) < 0.5)
