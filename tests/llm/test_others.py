import gzip
"""Archives, mixing, neighbours, toxicity and the pipeline."""

import base64
import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import test_decontamination
import test_jaccard
import test_lines
from pyspark.sql import functions as F

from proctrace.llm import ann, mixing, toxicity, warc
from proctrace.llm.common import new_path

D = "/root/testdata/sf0.001"


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_archives_round_trip(spark):
    big = "".join(chr(32 + i % 90) for i in range(200_000)) + "é\r\n\r\nWARC/1.1\r\nContent-Length: 5"
    rows = [(1, "http://a/\r\nx", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", big), (6, "u", "ü" * 40_000), (7, "u", "0\r\n\r\n"), (None, "u", "same"), (8, "u", big), (9, "u", "solo"), (9, "u", "solo")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    path = new_path(spark, "warc-test")
    warc.write_archives(pages, path, segment_bytes=1000, chunk_bytes=333, records_per_file=50)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows) and all(r["problem"] is None for r in got)
    keeper = defaultdict(int)
    for i, _, t in rows:
        keeper[t or ""] = max(keeper[t or ""], i or 0)
    expected = []
    for i, _, t in rows:
        data, first = (t or "").encode(), keeper[t or ""]
        expected.append((i, len(data), b32(data), "response" if i == first else "revisit", None if i == first else first, data if i == first else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got), key=str) == sorted(expected, key=str)


def test_small_payloads_are_all_responses_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    path = new_path(spark, "warc-test")
    warc.write_archives(pages, path, min_revisit_bytes=3)
    assert sorted((r["page_id"], r["record_type"]) for r in warc.read_archives(spark, path).collect()) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]
    path = new_path(spark, "warc-test")
    warc.write_archives(pages.where("false"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_broken_segments_are_reported():
    whole = list(warc._records(5, "u", b"z" * 5000, None, 1000, 300))
    parts = [(h, b) for r in whole for h, b in warc._parse(__import__("gzip").compress(r + b"\r\n\r\n"))]
    rows = [{"number": int(h["WARC-Segment-Number"]), "total": h.get("WARC-Segment-Total-Length"), "head": h if h["WARC-Segment-Number"] == "1" else None, "block": b} for h, b in parts]
    assert warc._reassemble(rows[::-1], True)[5] == b"z" * 5000
    assert warc._reassemble(rows[1:], True)[6] == "first segment is missing"
    assert warc._reassemble(rows[:2] + rows[3:], True)[6] == "segment numbers have gaps"
    assert warc._reassemble(rows[:-1], True)[6] == "total length differs"
    assert warc._reassemble([*rows[:-1], rows[-1] | {"block": b"1" + rows[-1]["block"]}], True)[6] == "total length differs"
    assert warc.dechunked(warc.chunked(b"", 5)) == b"" and warc.dechunked(warc.chunked(b"0\r\n" * 9, 4)) == b"0\r\n" * 9
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")


def test_numbers_beyond_their_range(spark, tmp_path):
    """Such a page id is none, such a segment number or length is damage; neither stops the job or turns into another number."""
    digest, block = warc.base32_sha1(b"x"), b"HTTP/1.1 200 OK\r\n\r\nx"
    record = lambda *more, kind="response", body=block: warc._record([("WARC-Type", kind), ("WARC-Record-ID", f"<{more}>"), ("WARC-Payload-Digest", f"sha1:{digest}"), *more], body)
    huge, wraps = str(10**30 + 7), "100000000000"
    records = [
        record(("X-Page-ID", huge)),
        record(("X-Page-ID", 2), ("WARC-Segment-Number", wraps)),
        record(("X-Page-ID", 3), ("WARC-Segment-Number", (1 << 32) + 1), ("WARC-Segment-Total-Length", len(block))),
        record(("X-Page-ID", 4), ("WARC-Segment-Number", 1), ("WARC-Segment-Total-Length", huge)),
        record(("X-Page-ID", 5), ("X-Refers-To-Page-ID", huge), kind="revisit", body=b"HTTP/1.1 200 OK\r\nContent-Length: 7\r\n\r\n"),
        record(("X-Page-ID", 6), kind="revisit", body=b"HTTP/1.1 200 OK\r\nContent-Length: " + huge.encode() + b"\r\n\r\n"),
        record(("X-Page-ID", 7)),
        record(("X-Page-ID", 8)).replace(b"Content-Length: %d" % len(block), b"Content-Length: " + huge.encode()),
        record(("X-Page-ID", 9)),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records))
    got = {(r["page_id"], r["payload_bytes"], r["refers_to"], r["problem"]) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    bad = "segment has no number or origin"
    assert {(None, 1, None, None), (2, None, None, bad), (3, None, None, bad), (4, None, None, "total length differs"), (5, 7, None, None), (6, None, None, "revisit has no length"), (7, 1, None, None), (9, 1, None, None)} <= got
    assert not [x for x in got if x[0] == 8 and x[3] is None]


def test_broken_records_are_rows_with_a_problem(spark, tmp_path):
    """One bad record or archive costs neither the job nor the records around it."""

    def record(i, payload=b"good", **change):
        (one,) = warc._records(i, "u", payload, None, 10_000, 300)
        for k, v in change.items():
            one = one.replace(*v) if k.startswith("swap") else one
        return one + b"\r\n\r\n"

    parts = [
        record(1),
        record(2, swap=(b"\r\nTransfer-Encoding: chunked\r\n\r\n", b"\r\nTransfer-Encoding: chunked\r\n\n\n"), swap2=(b"\r\n0\r\n\r\n", b"\r\n0\r\n\n\n")),
        record(3, swap=(b"WARC-Payload-Digest", b"WARC-Other-Digest")),
        record(4, swap=(b"WARC-Date: ", b"a line of no field\r\nWARC-Date: ")),
        b"\x00\xffnot a record\r\n\r\n",
        record(5, swap=(b"\r\n4\r\ngood", b"\r\n-\r\ngood")),
        record(6, swap=(b"Content-Length: ", b"Content-Length: many ")),
        record(7, swap=(b"X-Page-ID: 7", b"X-Page-ID: x")),
        record(8, swap=(b"X-Page-ID", b"WARC-Segment-Number: one\r\nX-Page-ID")),
        record(9, swap=(b"WARC-Type: response", b"WARC-Type: warcinfo")),
        record(10, swap=(b"WARC-Type: response", b"WARC-Type: revisit")),
        record(11),
        record(12)[:-12],
    ]
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"".join(parts)))
    noise = "".join(chr(33 + (i * i * 7919 + i // 3) % 90) for i in range(9_000)).encode()
    (tmp_path / "b.gz").write_bytes(gzip.compress(record(20) + record(21, noise) + record(22, noise[::-1]))[:-200])
    (tmp_path / "c.gz").write_bytes(b"no gzip at all")
    got = sorted(((r["page_id"], r["problem"]) for r in warc.read_archives(spark, str(tmp_path)).collect()), key=str)
    problems = [(2, "HTTP head has no end"), (3, "no payload digest"), (5, "broken chunked framing"), (8, "segment has no number or origin"), (10, "revisit has no length"), (12, "record is cut short")]
    none = [(None, "no WARC record")] * 2 + [(None, None)] + [(None, "compressed data is broken")] * 2
    assert [x for x in got if x[0] is None or x[0] < 20] == sorted([*problems, *none, *[(i, None) for i in (1, 4, 11)]], key=str)
    assert (20, None) in got and (22, None) not in got


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > cap * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
            open_.remove(s)
    return target


def check_mix(rows, mix):
    import re

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[2]] += size(r[1])
    target = plain_targets(sizes)
    got = mix.documents.join(mix.sources.select("rank", "skey"), "rank").collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r[0], size(r[1])) for r in rows)
    for r in got:
        s = None if r["skey"] == "1" else r["skey"][1:]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], target[s], rel_tol=1e-9, abs_tol=1e-9) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)


def check_shards(rows, mix):
    """The shards' words are those of the documents that their parts name, at the places these have in their source."""
    shards, placed = mix.shards.collect(), mix.documents.collect()
    by_place = {(r["rank"], r["start"]): r for r in placed if r["size"]}
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append((r[1] or "").split())
    assert {(r["rank"], r["slot"]): r["words"] for r in shards} == {(r["rank"], r["slot"]): r["words"] for r in mix.slots.collect()}
    taken = Counter()
    for r in shards:
        words, at = r["text"].split(" "), 0
        assert len(words) == r["words"]
        for p in r["parts"]:
            doc = by_place[r["rank"], p["start"]]
            first = r["block"] * 16 + p["low"] - p["start"]
            assert p["low"] == at and doc["doc_id"] == p["doc_id"]
            assert words[at : p["high"]] in [t[first : first + p["high"] - at] for t in texts[p["doc_id"]] if len(t) == doc["size"]]
            at, taken[r["rank"], p["start"]] = p["high"], taken[r["rank"], p["start"]] + p["high"] - p["low"]
        assert at == len(words)
    assert all(taken[k] == r["taken"] for k, r in by_place.items()) and len(by_place) == sum(1 for r in placed if r["size"])


def test_mixing(spark, docs):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 37)), None if i % 11 == 0 else f"s{i % 5}") for i in range(300)]
    rows += [(1000, None, "s1"), (1001, "x " * 20_000, "big"), (1002, "one", "tiny"), (7, rows[7][1], rows[7][2])]
    first, second = (mixing.mix_sources(docs(rows), block_words=16, shard_slots=64) for _ in range(2))
    check_mix(rows, first)
    key = lambda m: sorted(map(tuple, m.documents.collect()))
    assert key(first) == key(second)
    slots = first.slots.collect()
    assert len({(r["rank"], r["slot"]) for r in slots}) == len(slots) and len({r["shard"] for r in slots}) > 5
    check_shards(rows, first)
    for m in (mixing.mix_sources(docs([])), mixing.mix_sources(docs([(1, None, "a"), (2, "", None)]))):
        assert sum(r["taken"] for r in m.documents.collect()) == 0


def test_permutation(spark):
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        got = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(n * 7 + 1)).alias("p")).collect()
        assert sorted(r["p"] for r in got) == list(range(n))


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16))
    x[50:80] = x[50]
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(400)]
    rows += [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] * 16, 0), (1060, [1.0, None] * 8, 0), (1080, [1.0] * 3, 0), (None, [1.0] * 16, 0), (60, rows[60][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    exact = np.array([r[1] for r in rows[:400]], np.float32).astype(float)
    got = defaultdict(list)
    for r in ann.search(table, F.col("vec_id") % 20 == 0, most_lists=4, share=1.0, rerank=60, list_block=64, query_block=8).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 400, 20))
    for q, found in got.items():
        score = (exact * exact[q]).sum(1)
        best = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:20]
        assert [f[0] for f in found] == list(range(1, 21))
        assert len({f[1] for f in found} & set(best)) >= 18 and all(abs(f[2] - score[f[1]]) < 1e-9 for f in found)
    few = ann.search(table.where("vec_id < 5 or vec_id = 60"), F.col("vec_id") % 20 == 0).collect()
    assert Counter(r["query_id"] for r in few) == {0: 5, 60: 5}
    assert ann.search(table.where("vec_id = 1000"), F.col("vec_id") % 20 == 0).count() == 0


def recall_of(found, x, ids):
    by = found.toPandas().groupby("query_id")["vec_id"].apply(set)
    out = []
    for q, got in by.items():
        score = x @ x[ids == q][0]
        order = [i for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        out.append(len(got & set(order)) / 20)
    assert len(by) == (ids % 20 == 0).sum()
    return np.mean(out)


def test_neighbours_recall(spark):
    """Whole tables with production parameters; at most 105 of the entries are scored exactly for a query."""
    from proctrace.llm.queries import QUERIES

    for d in (D, "/root/testdata/sf0.1"):
        table = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
        x, ids = np.array(table["embedding"].tolist(), float), table["vec_id"].to_numpy()
        assert len(x) > 4 * 105 and recall_of(QUERIES["op7_ann_search"](spark, d), x, ids) >= 0.9


def test_neighbours_codes_decide(spark):
    """Of vectors in clusters, one of which holds half, a quarter of the lists and a small multiple of k find nearly all; lists are dealt to several shelves."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16)) * 4
    x = (centres[np.minimum(rng.integers(0, 60, 3000), 29)] + rng.normal(size=(3000, 16))).astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(table, F.col("vec_id") % 20 == 0, share=0.25, parts=16, rerank=63, list_block=100, query_block=64)
    assert recall_of(got, x, np.arange(3000)) >= 0.9
    exact = ann.search(table.where("vec_id < 300"), F.col("vec_id") % 20 == 0, share=1.0, parts=4, rerank=300)
    assert recall_of(exact, x[:300], np.arange(300)) == 1


def test_shelves():
    got = ann.shelves({0: 3, 1: 4, 2: 4, 5: 25, 6: 10}, 10)
    assert got == [(0, 0, 1), (1, 0, 1), (2, 1, 1), (5, 2, 3), (6, 5, 1)]
    held = np.array([5, 0, 50, 1])
    index = ann.Index(np.eye(4), 4, 2, 4)
    assert (index.probes(np.eye(4), 0.25, held, 6) @ held >= 6).all() and index.probes(np.eye(4), 1.0, held, 0).all()


def test_toxicity(spark, docs):
    from proctrace.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    rows = QUERIES["op5_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    score = np.array([r["score"] for r in rows])
    label = np.array([r["toxic"] for r in rows])
    rank = np.argsort(np.argsort(score))
    auc = (rank[label == 1].mean() - (label.sum() - 1) / 2) / (len(label) - label.sum())
    assert auc >= 0.75 and (score[label == 0] >= 0.5).mean() <= 0.05
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_window_lengths_by_hand():
    """Features come from plain compressed lengths of all windows under both dictionaries."""
    import zstandard

    model = toxicity.Model([f"you vile rotten thing number{i} vile" for i in range(60)], [f"a calm note about item{i} today" for i in range(60)], 0.5)
    text = "you vile rotten thing\nand a calm note about nothing"
    words = text.encode().split()
    sizes = []
    for content in model.contents:
        made = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append([len(made.compress(b" " + b" ".join(words[i : i + model.words]) + b" ")) for i in range(0, len(words), model.words)])
    saved = [o - t for t, o in zip(*sizes)]
    found = model.features(text)
    assert found[0] == max(saved) and math.isclose(found[4], sum(saved) / len(saved)) and math.isclose(found[5], math.log1p(len(saved)))


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    table = docs([(1, None), (2, ""), (None, "x"), (3, "word " * 50_000)])
    for l in (labels, labels.where("false")):  # noqa: E741
        got = toxicity.score_texts(table, toxicity.fit(table, l)).collect()
        assert len(got) == 4 and {r["score"] for r in got} == {0.0} and {r["doc_id"]: r["held_out"] for r in got}[None] is False
    clash = table.withColumnsRenamed({"size": "__id", "lang": "own_id", "source": "score"})
    assert toxicity.score_texts(clash, toxicity.fit(clash, labels)).count() == 4
    model = toxicity.Model(["bad word here"] * 3, ["good word here"] * 3, 0.5)
    assert toxicity.score_texts(docs([]), model).count() == 0
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_texts(table, model).collect())


def plain_pipeline(rows, score, items):
    """(doc_id, text, source) rows that are left before the mix."""
    rows = [r for r in rows if score(r[1] or "") < 0.5]
    removed = {r[0]: set(r[3].split(",")) - {""} for r in test_lines.plain([r[:2] for r in rows])}
    left = []
    for doc, text, source in rows:
        if gone := removed[doc]:
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if str(i) not in gone)
            if not test_jaccard.SPACE.search(text):
                continue
        left.append((doc, text, source))
    left.sort(key=lambda r: (r[0] is None, r[0] or 0))
    sets, holders, group = [test_jaccard.shingles(r[1], 5) for r in left], defaultdict(list), list(range(len(left)))

    def first(i):
        return i if group[i] == i else first(group[i])

    for i, s in enumerate(sets):
        for j in {j for e in s for j in holders[e]}:
            common = len(s & sets[j])
            if 5 * common >= 4 * (len(s) + len(sets[j]) - common):
                a, b = sorted((first(i), first(j)))
                group[b] = a
        for e in s:
            holders[e].append(i)
    left = [r for i, r in enumerate(left) if first(i) == i]
    hit = {r[0] for r in test_decontamination.plain([r[:2] for r in left], items) if r[5]}
    return [r for r in left if r[0] not in hit]


def test_pipeline_against_a_plain_fold(spark, tmp_path):
    """Each stage's decisions on its predecessor's output; null id, text and source, empty text, clashing names."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "source_mix"]
    docs = spark.read.parquet(f"{D}/documents.parquet")
    odd = [(900_001, None, "web"), (900_002, "", None), (900_003, "a line of its own that no other document has", None), (None, "words without any document number at all here", "web")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, source string"), allowMissingColumns=True)
    for name in ("own_id", "text_key", "size", "__id", "target"):
        docs = docs.withColumn(name, F.lit("x"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{D}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs, labels = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    given = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    left = plain_pipeline(given, model.score, items)
    words = {r[0]: len(test_jaccard.SPACE.findall(r[1] or "")) for r in left}
    assert len(left) < len(given) and {r["doc_id"]: r["size"] for r in rows} == words and len(rows) == len(left)
    sizes, taken = Counter(), Counter()
    source = {r[0]: r[2] for r in left}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    for s, target in plain_targets(sizes).items():
        assert abs(taken[s] - target) <= 1


def test_pipeline_stages_on_empty_and_repeated_tables(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{D}/documents.parquet")
    two = [(1, "one two three", "en", "s", 1)] * 2 + [(2, None, None, None, None)] * 2
    twice = spark.createDataFrame(two, docs.schema)
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs.limit(0), D)
        assert out.columns == docs.columns and out.count() == 0
        assert sorted(map(tuple, step(spark, twice, D).collect()), key=str) == sorted(two, key=str)
    assert corpus_pipeline.mix(spark, docs.limit(0), D).count() == 0
    mixed = sorted(map(tuple, corpus_pipeline.mix(spark, twice, D).collect()))
    assert mixed == [(1, 3, 6, 6.0, 3)] * 2 + [(2, 0, 0, 0.0, 0)] * 2
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{D}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.reject_toxic(spark, twice, str(tmp_path)).count() == 4
    assert corpus_pipeline.drop_contaminated(spark, twice, str(tmp_path)).count() == 4
