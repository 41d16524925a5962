import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proctrace.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, key string, vec string"


def plain(rows, anchor):
    good = {(i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, lab, *_ in rows if i is not None and lab is not None and v is not None and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, lab, v in good:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in good if j != i)
        for s, j in [(-s, j) for s, j, m in scored if m == lab][:5]:
            fit = [(-t, x) for t, x, m in scored if m != lab and 30 * s <= -100 * t <= 90 * s][:10]
            out += [(i, j, r, x, s, t) for r, (t, x) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard_rows", "block"), [(13, 3), (64, 100), (4096, 1024)])
def test_against_brute_force(spark, shard_rows, block):
    """Groups of near and equal vectors, ties, zeros, bad rows, repeated rows and ids, another length, clashing names."""
    rng = random.Random(shard_rows)
    rows = []
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    for i in range(400):
        c = rng.choice(centres)
        v = c if rng.random() < 0.2 else [x + rng.gauss(0, 0.4) for x in c]
        rows.append((i, v, rng.randrange(4)))
    rows += [(1000 + i, [0.0] * 6, i % 3) for i in range(20)] + [(1100 + i, [1.0] * 6, i % 4) for i in range(40)]
    rows += [(2000, None, 1), (2020, [1.0] * 6, None), (2040, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (2060, [float("nan")] * 6, 1), (2080, [float("inf")] * 6, 1), (2100, [1.0] * 5, 1), (2120, [], 1), (None, [1.0] * 6, 1)]
    rows += [rows[0], rows[20], (20, [0.5] * 6, 2), (3000, [9.0] * 6, 77)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    got = negatives.mine(df, F.col("vec_id") % 20 == 0, shard_rows=shard_rows, block_anchors=block)
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 20 == 0)
    assert negatives.mine(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0).collect() == []
    assert negatives.mine(df.where("vec_id = 20"), F.col("vec_id") % 20 == 0).collect() == []


def test_lists_are_left_early_where_vectors_have_structure():
    """Long-tailed components: the threshold falls below the last wanted score after a small part of the rows; numbers beyond 2 ** 53 stay whole."""
    rng = np.random.default_rng(1)
    v = np.floor(rng.standard_cauchy((4000, 8)) * 256).astype(np.int64)
    shard = negatives.Shard(np.arange(4000), np.zeros(4000, np.int64), v, np.argsort(v, axis=0, kind="stable").T.astype(np.int32))
    for a in (v[np.argmax(np.abs(v).sum(1))], v[7], -v[7], 0 * v[7]):
        one = negatives.Search(5, lambda ids, labels, s: np.ones(len(ids), bool))
        before = shard.met
        shard.search(a, [one])
        exact = v @ a
        best = np.lexsort((np.arange(4000), -exact))[:5]
        assert (one.ids == best).all() and (one.scores == exact[best]).all()
        assert shard.met - before < 1000 or not a.any()
