import random
import re

import numpy as np
import pytest

from proctrace.llm import jaccard
from proctrace.llm.components import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=3):
    w = SPACE.findall((text or "").translate(LOWER))
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def plain(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_element = {}
    for i, s in enumerate(sets):
        for e in s:
            by_element.setdefault(e, []).append(i)
    seen = set()
    for i, s in enumerate(sets):
        for j in {j for e in s for j in by_element[e] if j > i}:
            common = len(s & sets[j])
            if 100 * common >= 90 * (len(s) + len(sets[j]) - common):
                seen.add((i, j))
    for i, j in seen:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], len(sets[i]), r[0] if not sets[i] else least.get(find(i))) for i, r in enumerate(rows)), key=str)


def got(frame):
    return sorted((tuple(r) for r in jaccard.jaccard_classes(frame).drop("text_key").collect()), key=str)


def near(rng, words, changes):
    w = list(words)
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def test_against_all_pairs(spark, docs):
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, "a"), (4, "A"), (5, "a b"), (6, "a b c"), (7, " \t"), (None, "a b c"), (8, "a b"), (9, "É x y z"), (10, "é x y z")]
    for size in (4, 10, 14, 21, 40, 90, 300):
        for _ in range(3):
            base = [f"w{rng.randrange(60 if size < 50 else 5000)}" for _ in range(size)]
            rows += [(100 + len(rows), near(rng, base, c)) for c in (0, 0, 0, 1, 1, 1, 2, 3, 5) if c * 12 <= size + 12]
    chain = [f"c{i}" for i in range(200)]
    for k in range(12):  # each links with the next alone
        rows.append((1000 + k, " ".join(chain[4 * k : 4 * k + 150])))
    rows.append(rows[-1])
    assert got(docs(rows)) == plain(rows)


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5)])
def test_signatures_lose_no_similar_pair(num, den):
    rng = np.random.default_rng(1)
    starts = jaccard.band_starts(3000, 1.3)
    deletions = [b._replace(segments=b.segments - k, deletions=k) if b.segments >= 2 * k else b for b in jaccard.allocate(starts, {}, num, den) for k in [min(2, b.segments // 3)]]
    tried = 0
    for bands in (jaccard.allocate(starts, {}, num, den), jaccard.allocate(starts, {b: 10**7 for b in range(60)}, num, den), deletions):
        for _ in range(1500):
            n = int(rng.integers(1, 80) if rng.random() < 0.7 else rng.integers(80, 500))
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            h = int(2 * len(a) * (den - num) / (den + num)) + 1
            drop = min(len(a) - 1, int(rng.integers(0, h + 1)))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, h + 2))).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if den * common >= num * (len(a) + len(b) - common):
                tried += 1
                lists = [jaccard.signatures(x, starts, bands, num, den) for x in (a, b)]
                assert len(np.intersect1d(lists[0][0], lists[1][0]))
                assert len(np.intersect1d(*[left(*x) for x in lists]))
    assert tried > 500


def left(sigs, tags):
    """What stays when each list leaves out its most common signatures, in any order that all sets share."""
    common = jaccard.mix(sigs) % np.uint64(1000)
    out = [sigs[tags % 2 == 0]]
    for name in np.unique(tags >> 8):
        mine = np.flatnonzero((tags >> 8 == name) & (tags % 2 == 1))
        order = mine[np.lexsort((sigs[mine], common[mine]))]
        slack = int(tags[mine[0]] >> 1 & 127) if len(mine) else 0
        out.append(sigs[order[: len(order) - min(slack, len(order))]])
    return np.concatenate(out)


def test_wide_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    assert jaccard.wide_sketch(np.arange(64 * jaccard.SKETCH, dtype=np.uint64)) is None
    for _ in range(60):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1100, 6000))).astype(np.uint64))
        b = np.unique(np.concatenate([a[int(rng.integers(0, len(a) // 3)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 1500))).astype(np.uint64)]))
        if len(b) > 64 * jaccard.SKETCH:
            x, y = jaccard.wide_sketch(a), jaccard.wide_sketch(b)
            apart = len(np.setxor1d(a, b))
            assert jaccard.parity_bits_apart(x, y) == jaccard.parity_bits_apart(y, x) <= apart
            assert jaccard.parity_bits_apart(x, y) % 2 == apart % 2
    unlike = [np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64)) for _ in range(2)]
    assert jaccard.parity_bits_apart(*map(jaccard.wide_sketch, unlike)) * 9 > 8000  # rejected at a similarity of 0.8, too


def test_long_texts_that_share_passages(spark, docs):
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(200)]
    rows = []
    for size in (1000, 1030, 1300, 2050, 5000):
        for _ in range(3):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            at = rng.randrange(size)
            base[at:at] = passage
            rows += [(len(rows) + k, near(rng, base, c)) for k, c in enumerate((0, size // 70, size // 50, size // 20))]
    assert got(docs(rows)) == plain(rows)


def test_empty_table_and_representatives(spark, docs):
    assert got(docs([])) == []
    table = docs([(1, "a b c d"), (2, "a b c d"), (3, ""), (4, None), (5, "q r s t"), (None, "a b c d"), (2, "a b c d")])
    kept = jaccard.one_of_each(table)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]


def test_components_of_a_path_and_a_star(spark):
    rng = random.Random(5)
    ids = list(range(300))
    rng.shuffle(ids)
    edges = list(zip(ids[:200], ids[1:200])) + [(ids[250], x) for x in ids[251:]]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[x] for x in ids[:200]} == {min(ids[:200])} and {found[x] for x in ids[250:]} == {min(ids[250:])}


def test_registered_query(spark):
    from proctrace.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op4_ngram_jaccard"](spark, d).collect()), key=str) == plain(rows)
