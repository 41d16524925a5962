"""Neighbours are exact on any rows: bounds of the codes' errors decide what is scored."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proctrace.llm import ann

RNG = np.random.default_rng(5)
N = 1200
ROWS = {
    # half of all rows are near copies of one vector; before, 0.875 of the nearest were found on 4,000 such rows
    "near copies": np.concatenate([RNG.normal(size=(N // 2, 64)), RNG.normal(size=(1, 64)) + 1e-6 * RNG.normal(size=(N // 2, 64))])[RNG.permutation(N)],
    "lengths": RNG.normal(size=(N, 24)) * RNG.lognormal(0, 1.5, size=(N, 1)),
    # few distinct scores: most queries have more ties than are fetched by id
    "ties": (RNG.random((N, 12)) < 0.3).astype(float),
}


def expected(x):
    rows, ids = {}, np.arange(len(x))
    for q in ids[ids % 20 == 0]:
        if x[q].any():
            score = np.zeros(len(x))
            for c in range(x.shape[1]):
                score += x[:, c] * x[q, c]
            best = [i for i in np.lexsort((ids, -score)) if i != q and x[i].any()][:20]
            rows[int(q)] = [(r + 1, int(i), float(score[i])) for r, i in enumerate(best)]
    return rows


@pytest.mark.parametrize("kind", ROWS)
@pytest.mark.parametrize("options", [{}, {"parts": 5, "rerank": 30, "list_block": 150, "query_block": 16}])
def test_exact_on_any_rows(spark, kind, options):
    x = ROWS[kind]
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got == expected(x)


def test_levels_and_bounds():
    x = RNG.standard_t(1.5, size=(500, 6))
    assert {1.0, 3.0} <= set(ann.levels(np.array([3.0, 1.0, 1.0]), 256, 8))
    for parts in (2, 6):
        index = ann.Index(x[:200], 5, parts, 16)
        near, code, lengths, error = index.encode(x)
        assert (np.linalg.norm(x - index.decode(near, code, lengths), axis=1) <= error).all()
