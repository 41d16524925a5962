import random

import numpy as np
from test_jaccard import near, shingles

from proctrace.llm import minhash


def plain(rows, n=2, num=80):
    sets = [shingles(r[1], n) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            common = len(s & sets[j])
            if common and 100 * common >= num * (len(s) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    own = [r[0] if not sets[i] else least.get(find(i)) for i, r in enumerate(rows)]
    return sorted(((r[0], len(sets[i]), own[i], r[0] == own[i]) for i, r in enumerate(rows)), key=str)


def got(frame, **options):
    return sorted((tuple(r) for r in minhash.near_duplicates(frame, **options).drop("text_key").collect()), key=str)


def test_against_all_pairs(spark, docs):
    """Small and large sets, ties, copies, chains whose ends aren't similar, and sets near a common one but not each other."""
    rng = random.Random(8)
    rows = [(1, None), (2, ""), (3, "a"), (4, "A"), (5, "a b"), (6, "A  b"), (7, " \t"), (None, "a b c"), (8, "a b c"), (9, "É x y z"), (10, "é x y z"), (11, "a b a b")]
    for size in (4, 10, 21, 60, 300, 2000):
        for _ in range(3):
            base = [f"w{rng.randrange(60 if size < 50 else 5000)}" for _ in range(size)]
            rows += [(100 + len(rows), near(rng, base, c)) for c in (0, 0, 1, 1, 2, 3, 5, 8, size // 20, size // 15, size // 12)]
    chain = [f"c{i}" for i in range(300)]
    rows += [(5000 + k, " ".join(chain[5 * k : 5 * k + 60])) for k in range(40)]
    base = [f"s{i}" for i in range(200)]
    rows += [(9000 + k, near(rng, base, 9)) for k in range(30)]
    rows.append(rows[-1])
    rng.shuffle(rows)
    assert got(docs(rows)) == plain(rows)


def test_empty_table(spark, docs):
    assert got(docs([(1, "x")]).where("doc_id > 1")) == []


def test_band_values_agree_as_often_as_sets_do():
    """Both ends of the permutations: agreement is the similarity, and what is read of a set doesn't depend on its neighbours."""
    rng = np.random.default_rng(3)
    for shared, alone in ((800, 100), (500, 250)):
        a, b, c = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (shared, alone, alone))
        x, y = np.concatenate([a, b]), np.concatenate([a, c])
        values = minhash.band_values([x, y], 1, 2000)
        share = (values[0] == values[1]).mean()
        assert abs(share - shared / (shared + 2 * alone)) < 0.03
        assert (minhash.band_values([y], 1, 50)[0] == minhash.band_values([x, y], 1, 50)[1]).all()
