import hashlib
import re

import pytest

from proctrace.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, n=13):
    windows = {}
    for item, text in items:
        w = words(text)
        if w and item is not None:
            k = min(n, len(w))
            for i in range(len(w) - k + 1):
                windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    widths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in widths:
            for i in range(len(w) - k + 1):
                if got := windows.get(tuple(w[i : i + k])):
                    found |= got
                    hit.update(range(i, i + k))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def run(frame, items):
    return [tuple(r)[:1] + tuple(r)[2:7] for r in decontamination.decontaminate(frame, items).collect()]


def key(rows):
    return sorted(rows, key=str)


LONG = " ".join(f"w{i}" for i in range(40))


def cases():
    items = [(1, LONG), (2, "short item"), (3, "Éa b-c"), (10, LONG + " more"), (4, None), (5, "..."), (None, "null id words"), (6, "one")]
    docs = [
        (1, None), (2, ""), (3, "x " * 300 + LONG.upper()), (4, " ".join(LONG.split()[5:17])), (5, " ".join(LONG.split()[5:18])), (6, "a short, ITEM! of éa b c and Éa b c"),
        (7, ("y " * 2000) + " ".join(LONG.split()[:13])), (8, LONG + " z " + LONG), (8, LONG + " z " + LONG), (None, "one two"), (9, "w0 w1 w2 short"),
    ]
    return docs, items


def test_against_plain_windows(spark, docs):
    rows, items = cases()
    table = spark.createDataFrame(items, "item_id long, text string")
    assert key(run(docs(rows), table)) == key(plain(rows, items))


# no broadcast by rows, none by bytes, and the windows alone
@pytest.mark.parametrize("limit", [{"broadcast_rows": 0}, {"broadcast_bytes": 0}, {"broadcast_rows": 60}])
def test_shuffled_lookup_gives_the_same(spark, docs, limit):
    rows, items = cases()
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(docs(rows), table, **limit)
    assert key([tuple(r)[:1] + tuple(r)[2:7] for r in got.collect()]) == key(plain(rows, items))


def test_empty_tables_and_cleaning(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert run(docs([]), none) == []
    assert key(run(docs([(1, "a b")]), none)) == key(plain([(1, "a b")], []))
    items = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    table = docs([(1, LONG), (2, "clean"), (None, LONG), (3, None)])
    clean = decontamination.clean_documents(table, items)
    assert clean.columns == table.columns and sorted(str(r["doc_id"]) for r in clean.collect()) == ["2", "3"]


def test_registered_query(spark):
    from proctrace.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    load = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{d}/{t}.parquet").select(*c).collect()]
    assert key([tuple(r) for r in QUERIES["op3_decontaminate"](spark, d).collect()]) == key(plain(load("documents", "doc_id", "text"), load("benchmark", "item_id", "text")))
