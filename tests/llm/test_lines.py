import random
import re

from proctrace.llm import lines


def plain(rows):
    seen, out = [], {}
    unique = sorted({(r[0] is None, r[0] or 0, i) for i, r in enumerate(rows)})
    done = {}
    for _, _, i in unique:
        doc, text = rows[i]
        if (doc, text) in done:
            continue
        gone = []
        for no, line in enumerate([] if text is None else text.split("\n")):
            s = set(re.findall(r"[^\x20\x09-\x0D]+", line))
            if not s:
                continue
            if any(5 * len(s & t) >= 4 * len(s | t) for t in seen):
                gone.append(no)
            seen.append(s)
        done[(doc, text)] = (doc, 0 if text is None else len(text.split("\n")), len(gone), ",".join(map(str, gone)))
    return sorted((done[r] for r in rows), key=str)


def got(frame):
    return sorted((tuple(r) for r in lines.line_report(frame).collect()), key=str)


def test_against_all_pairs(spark, docs):
    rng = random.Random(4)
    pool = [f"w{rng.randrange(400)}" for _ in range(5000)]
    kinds = []
    for size in (1, 2, 4, 5, 6, 9, 10, 15, 30, 80, 200):
        base = rng.sample(pool, size)
        for c in (0, 0, 1, 1, 2, 3, size // 9, size // 5):
            w = list(base)
            for _ in range(min(c, size)):
                w[rng.randrange(size)] = f"n{rng.randrange(9999)}"
            rng.shuffle(w)
            kinds.append(" ".join(w))
    rng.shuffle(kinds)
    rows = [(i, "\n".join(rng.choice(kinds) for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n \t"), (103, "É x\nÉ x\né x"), (103, "É x\nÉ x\né x"), (None, kinds[0])]
    assert got(docs(rows)) == plain(rows)


def test_variants_of_one_template_stay_few_pairs(spark, docs):
    """Any two variants are similar (9 of 11 words), yet pairs grow with the lines, not their square."""
    words = "the quick brown fox jumps over one lazy"
    rows = [(i, f"{words} dog{i} x\nother{i} line{i}") for i in range(2000)]
    found = {r["doc_id"]: r["removed"] for r in lines.line_report(docs(rows)).collect()}
    assert found == {0: "", **{i: "0" for i in range(1, 2000)}}
    made = []
    for n in (500, 2000):
        base = docs(rows[:n]).select("doc_id", "text", "text_key")
        seen = {}
        real = lines._verified
        lines._verified = lambda b, f, pairs, *a: (seen.setdefault("n", []).append(pairs.count()), real(b, f, pairs, *a))[1]
        try:
            lines.repeated_lines(base).count()
        finally:
            lines._verified = real
        made.append(sum(seen["n"]))
    assert made[1] <= 6 * made[0] + 4000


def test_likeliest_candidates_settle_dense_groups(spark, docs, monkeypatch):
    """Of near copies that are often just not similar, few of the candidate pairs are held against each other word by word."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(70)]
    rows = [(i, " ".join(f"n{rng.randrange(10**6)}" if rng.random() < 0.1 else w for w in base)) for i in range(400)]
    made, real = {}, lines.stage

    def seen(df, label, *rest):
        out = real(df, label, *rest)
        if "likely" in out.columns:
            made["pairs"] = out
        if label == "line-likely":
            others = made["pairs"].where("not likely").join(out.withColumnRenamed("id", "late"), "late", "left_anti").count()
            made["verified"], made["all"] = made["pairs"].where("likely").count() + others, made["pairs"].count()
        return out

    monkeypatch.setattr(lines, "stage", seen)
    assert got(docs(rows)) == plain(rows)
    print(made["verified"], made["all"])
    assert made["all"] > 1000 and 3 * made["verified"] < made["all"]


def test_a_text_is_split_once_for_all_its_lines(spark, docs, monkeypatch):
    """No line of a text has it split anew, and no line makes the table of the bands' least sizes."""
    plans, real = [], lines.stage
    monkeypatch.setattr(lines, "stage", lambda df, *rest: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df, *rest))[1])
    rows = [(i, f"a b c d e\nx{i} y z\nf g h i j k{i}") for i in range(3)]
    assert got(docs(rows)) == plain(rows)
    assert plans and not [x for x in plans if re.search(r"split\([^()]*, -1\)\[", x) or "EXP(" in x]


def test_long_and_hot_lines(spark, docs):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30_000))
    near = long.replace("w1", "v1", 1500)
    rows = [(1, long), (2, near), (3, long + " more"), (4, None)] + [(10 + i, "\n".join(["the same line here"] * 50 + [f"the {i} b c"])) for i in range(60)]
    assert got(docs(rows)) == plain(rows)


def test_documents_without_repeats(spark, docs):
    table = docs([(1, "a b c d e\nonly here now"), (2, "a b c d e"), (3, "x\n\na b c d e f\ny z"), (4, None), (5, "")])
    kept = lines.without_repeats(table)
    assert kept.columns == table.columns
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {1: "a b c d e\nonly here now", 3: "x\n\ny z", 4: None, 5: ""}
    assert lines.line_report(docs([])).count() == 0
    named = table.withColumnsRenamed({"text_key": "own_id", "size": "gone_nos", "lang": "__lines"})
    kept = lines.without_repeats(named)
    assert kept.columns == named.columns and kept.count() == 4


def test_registered_query(spark):
    from proctrace.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op6_line_dedup"](spark, d).collect()), key=str) == plain(rows)
