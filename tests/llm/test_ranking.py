import math
import random
import re

import numpy as np
import pytest

from proctrace.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    bags = [(d[0], terms(d[1])) for d in docs]
    n_docs, n_terms = sum(bool(t) for _, t in bags), sum(len(t) for _, t in bags)
    df: dict = {}
    for _, t in bags:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in set(items):
        asked = [w for w in terms(text) if w in df]
        scores = []
        for doc, t in bags:
            m = 75 + 25 * len(t) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * t.count(w) // (1000 * t.count(w) + 12 * m)) for w in asked if w in t)
            if s:
                scores.append((s, doc))
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, i, doc, s) for i, (s, doc) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def made(rng, n):
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(common if rng.random() < 0.7 else rare) for _ in range(rng.choice([1, 5, 30, 80])))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "--- !!"), (n + 3, "É, É x_Y"), (None, "c1 c2 r1"), (n + 4, "c1 c2 r1"), (n + 4, "c1 c2 r1"), (n + 5, "C1 c2 R1")]
    items = [(i, " ".join(rng.choice(common + rare[:40]) for _ in range(rng.choice([1, 3, 12])))) for i in range(25)]
    return docs, [*items, (90, None), (91, ""), (92, "nowhere"), (93, "é y"), items[0], (0, "c1 r1 r1 unlike"), (94, "c1 c2 r1")]


@pytest.mark.parametrize("shard_docs", [7, 150, 16_384])
def test_against_brute_force(spark, docs, shard_docs):
    """Shards small and large, ties, repeated rows and items, null ids."""
    rows, items = made(random.Random(shard_docs), 700)
    index = ranking.build_index(docs(rows).repartition(2), shard_docs=shard_docs)
    got = ranking.search(index, spark.createDataFrame(items, "item_id long, text string"), k=9, block_items=4)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, items, 9)


def test_nothing_to_search(spark, docs):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.rank_documents(docs([(1, None)]), items).collect() == []
    assert ranking.rank_documents(docs([(1, "a")]).where("doc_id > 1"), items).collect() == []
    assert ranking.rank_documents(docs([(1, "a")]), items.where("item_id > 1")).collect() == []


def test_blocks_are_rejected_before_they_are_decompressed():
    """A rare term's documents set the score to reach; of the common term's many blocks few are read, and the result is the same."""
    rng = np.random.default_rng(4)
    texts = [b" ".join([b"common"] * int(rng.integers(1, 4)) + [b"pad"] * int(rng.integers(1, 60)) + [b"rare"] * (i % 150 == 3)) for i in range(20_000)]
    words: dict = {}
    parts = [ranking._counts(texts, 0, words)]
    rows = [r for batch in ranking._shard_rows("s", list(range(20_000)), parts, words) for r in batch.to_pylist() if r["term"] in ("common", "rare")]
    m = 75 + 25 * parts[0][3].astype(np.int64) * 20_000 // int(parts[0][3].sum())

    class Row:
        def __init__(self, r, w):
            self.__dict__ |= r | {"w": w, "least": 75 + 25 * np.asarray(r["least"], np.int64) * 20_000 // int(parts[0][3].sum())}

    lists = {r["term"]: ranking._List(Row(r, 1), m) for r in rows}
    weights = {"common": 1, "rare": 50}
    places, scores = ranking.best_of_shard(list(lists.values()), [weights[t] for t in lists], np.arange(20_000), 20)
    read = len(lists["common"].known)
    exact = np.zeros(20_000, np.int64)
    for t, x in lists.items():
        for i in range(len(x.last)):
            place, s = x.block(i)
            exact[place] += weights[t] * s
    best = np.lexsort((np.arange(20_000), -exact))[:20]
    assert (places == best).all() and (scores == exact[best]).all()
    assert read < len(lists["common"].last) / 2
