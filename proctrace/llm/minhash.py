"""Near-duplicate classes by min-max hashing.

Under each of ``groups * rows`` permutations of the shingles' hashes both the smallest and the
largest value are kept, so half the hash evaluations give as many values. The smallest ones of
``rows`` permutations are a band, and so are their largest ones: each agrees with probability s **
rows in sets of similarity s, since either end of a permutation agrees with probability s; the two
ends can't both miss by the same shingle, so bands fail together less often than by chance. No band
holds both ends of one permutation. A pair of similarity s is missed with probability of at most
(1 - s ** rows) ** (2 * groups): with 4 and 24, 1e-11 at 0.8 and 1e-22 at 0.9.

Sets that share a band are candidates; what follows is exact: equal sets are one node, candidates
pass bounds on sizes and parity sketches, links are confirmed on whole sets, and classes are the
components of the links. First each node is held against the smallest of its bands, then, where
classes remain apart, against each other (jaccard._links).

Defined cases: fewer words than n: the whole sequence is the one shingle; no words, or null: the
empty set, linked with nothing, kept; a null id takes part, and a class's id is its smallest id
that isn't null; repeated rows are equal sets, and are kept or go together; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proctrace.llm import jaccard
from proctrace.llm.bytes import mix
from proctrace.llm.common import same_row, stage, text_key


def band_values(sets: list[np.ndarray], rows: int, groups: int, seed: int = 7) -> np.ndarray:
    """A row for each set, none empty, with its 2 * groups band values."""
    joined = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    salts = mix(np.arange(1, groups * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    out = np.empty((len(sets), 2 * groups), np.uint64)
    for g in range(groups):
        low = np.full(len(sets), 2 * g + 1, np.uint64)
        high = np.full(len(sets), 2 * g + 2, np.uint64)
        for salt in salts[g * rows : (g + 1) * rows]:
            v = (joined ^ salt) * (salt | np.uint64(1))
            v ^= v >> np.uint64(32)
            v *= np.uint64(0xD6E8FEB86659FD93)
            low = mix(low * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(v, starts))
            high = mix(high * np.uint64(0x9E3779B97F4A7C15) + np.maximum.reduceat(v, starts))
        out[:, 2 * g], out[:, 2 * g + 1] = low, high
    return out


def near_duplicates(docs: DataFrame, *, n: int = 2, num: int = 4, den: int = 5, rows: int = 4, groups: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept), a row per document; linked at similarity num / den."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key"))

    def bands_of(sets: list[np.ndarray]) -> pa.Array:
        full = [s for s in sets if len(s)]
        values = band_values(full, rows, groups).ravel().view(np.int64) if full else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum([2 * groups * (len(s) > 0) for s in sets])))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))

    def links_of(sets: DataFrame, leads: DataFrame) -> DataFrame:
        each = stage(sets.where("n_shingles > 0").groupBy("node").agg(F.first("bands").alias("bands")), "mh-bands")

        def texts_of(involved: DataFrame) -> DataFrame:
            some = leads.join(involved, "node", "left_semi")
            # texts are sorted into place at any size; no table of ids is sent to all tasks
            return base.join(some.hint("merge"), same_row(base, some)).select("node", "text").dropDuplicates(["node"])

        return jaccard._links(each.select(F.explode("bands").alias("sig"), "node"), each, texts_of, n, num, den)

    found = jaccard.classes(base, n, links_of, bands_of)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
