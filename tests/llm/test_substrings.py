import hashlib
import random

import numpy as np

from proctrace.llm import substrings


def plain(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - length + 1):
                first[b[k : k + length]] = min(i, first.get(b[k : k + length], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for k in range(len(b) - length + 1):
                if first[b[k : k + length]] < i:
                    gone[k : k + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in substrings.remove_repeats(frame, keep_bytes=False).collect()), key=str)


def test_against_all_windows(spark, docs):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, other = text(400), text(120)
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 300), (6, passage), (7, text(100) + passage + text(70)), (8, passage[30:90]), (9, passage[100:149] + "q" + passage[150:210]), (10, passage), (10, passage), (None, passage)]
    rows += [(20 + i, text(60) + other[i : i + 60 + i] + text(60)) for i in range(20)]
    rows += [(50, "ab" * 100), (51, "ab" * 200), (52, "a" + "ab" * 30), (53, passage[:200] + other + passage[200:])]
    rng.shuffle(rows)
    assert got(docs(rows)) == plain(rows)


def test_empty_table_and_kept_bytes(spark, docs):
    assert got(docs([])) == []
    rows = {r["doc_id"]: bytes(r["kept"]) for r in substrings.remove_repeats(docs([(1, "q" * 60), (2, "é" + "q" * 60 + "z")])).collect()}
    assert rows == {1: b"q" * 60, 2: "éz".encode()}


def test_registered_query(spark):
    from proctrace.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op10_repeated_bytes"](spark, d).collect()), key=str) == plain(rows)
