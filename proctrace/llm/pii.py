"""Personal data: base patterns, and boosted trees over candidates of high recall.

Base spans match the patterns of ``BASE`` and pass their tests. The method adds spans:
generators of high recall (loose mail addresses, digit groups with separators) propose
candidates that may overlap each other and base spans. Boosted trees score each by format
(length, digits, separators, groups, a plus sign, distinct digits) and context (words before
it). No table marks personal data, so the trees learn from the base tests: a candidate that a
base span covers is label 1, while the tests' own outcome (check digits, part values) is not a
feature. The threshold is calibrated on the fold of the candidates that the fit didn't see, as the
lowest score whose precision reaches ``precision``. Candidates over it that overlap no base
span become spans of kind ``likely``; where candidates overlap each other, the earlier,
then the longer one stays.

Fit and threshold cover all distinct candidates: those alike in features and label are a row with
their count as its weight, so there are few rows however many the candidates.
Scoring is a Column expression read out of the model; only DataFrame functions are used.

Defined cases: a null text is empty; texts without matches have no spans; each row gives a row;
a null id stays null; with no candidates, or none of one label, no spans are added; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proctrace.llm.boosting import fit_trees
from proctrace.llm.common import bound, scanned, stage
from proctrace.llm.secrets import count_kind
from proctrace.llm.spans import SPAN, labelled, listed, matches

#: Fixed by the contract, written so that no run of characters is scanned twice.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: High-recall generators: addresses with loose separators, and groups of seven or more digits.
LOOSE_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?(?:@|\(at\)|\[at\])\x20?)[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)*+"
LOOSE_NUMBER = r"(?<![0-9A-Za-z])\+?(?:\([0-9]++\)\x20?)?[0-9]++(?:[\x20./()-]{1,2}[0-9]++)*+"
CUES = r"(?i)(mail|contact|kontakt|correo|courriel|phone|tel|call|fax|mobil|card|karte|carte|tarjeta|account|konto|ip|address|adresse|host)"

FEATURES = ["size", "digits", "letters", "groups", "plus", "at", "dots", "dashes", "spaces", "brackets", "longest", "distinct", "cue", "before_space"]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def value(i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def base_spans(text: Column) -> list[Column]:
    """Spans of each kind, in order."""
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{0,2})"
    digits = lambda x: F.char_length(_digits(x["match"]))
    ip = F.filter(matches(text, IP), lambda x: x["match"].rlike(rf"^{part}(?:\.{part}){{3}}$"))
    card = F.filter(matches(text, CARD), lambda x: (F.char_length(x["match"]) >= 12) & F.when(digits(x).between(12, 19), luhn(_digits(x["match"]))).otherwise(F.lit(False)))
    phone = F.filter(matches(text, PHONE), lambda x: digits(x).between(9, 15))
    found = (matches(text, EMAIL), ip, card, phone)
    return [labelled(x, k, i).cast(SPAN) for i, (x, k) in enumerate(zip(found, KINDS))]


def candidates(text: Column) -> Column:
    """Candidates of both generators with the text before them, by place: array of (low, high, match, before)."""
    loose = F.concat(F.filter(matches(text, LOOSE_NUMBER, before=24), lambda x: F.char_length(_digits(x["match"])) >= 7), matches(text, LOOSE_MAIL, before=24))
    return F.array_sort(F.transform(loose, lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"), x["match"].alias("match"), x["before"].alias("before"))))


def features(match: Column, before: Column) -> dict[str, Column]:
    without = lambda p: (F.char_length(match) - F.char_length(F.regexp_replace(match, p, ""))).cast("double")
    runs = F.filter(F.split(match, "[^0-9]+"), lambda x: x != "")
    return {
        "size": F.char_length(match).cast("double"), "digits": without("[0-9]"), "letters": without("[A-Za-z]"), "groups": F.size(runs).cast("double"),
        "plus": match.startswith("+").cast("double"), "at": F.contains(match, F.lit("@")).cast("double"), "dots": without(r"\."), "dashes": without("-"),
        "spaces": without(" "), "brackets": without(r"[()\[\]]"), "longest": F.coalesce(F.array_max(F.transform(runs, F.char_length)), F.lit(0)).cast("double"),
        "distinct": F.size(F.array_distinct(F.split(_digits(match), ""))).cast("double"), "cue": before.rlike(CUES).cast("double"), "before_space": before.rlike(r"(^|\s)$").cast("double"),
    }


def _overlaps(spans: Column, x: Column) -> Column:
    """Whether x overlaps one of spans, which are in order and apart: by the last one that starts before x ends."""
    n = F.size(spans)
    halve = lambda lo, hi: bound(F.floor((lo + hi) / 2).cast("int"), lambda mid: F.when(F.get(spans, mid)["low"] < x["high"], F.struct((mid + 1).alias("lo"), hi.alias("hi"))).otherwise(F.struct(lo.alias("lo"), mid.alias("hi"))))
    step = lambda acc, _: F.when(acc["lo"] < acc["hi"], halve(acc["lo"], acc["hi"])).otherwise(acc)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1.0)).cast("int"))
    before = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), step, lambda acc: acc["lo"])
    return F.when(n > 0, F.coalesce(bound(before, lambda k: F.get(spans, k - 1)["high"] > x["low"]), F.lit(False))).otherwise(F.lit(False))


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.98, trees: int = 8, depth: int = 3) -> DataFrame:
    """(doc_id, base, extra): arrays of spans, a row per document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    scan = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for c, k in zip(base_spans(text), KINDS)], candidates(text).alias("found"))
    covered = lambda x: _any([_overlaps(F.col(k), x) for k in KINDS])
    # found twice computed would scan the text twice; a staged table is read once for each use
    scan = stage(scan, "pii-scan")
    labels = F.transform("found", lambda x: F.struct(covered(x).alias("known"), x["low"].alias("low"), x["high"].alias("high"), x["match"].alias("match"), x["before"].alias("before")))
    one = scan.where("size(found) > 0").select(F.explode(labels).alias("x")).select(F.col("x.known").cast("double").alias("label"), "x.match", "x.before")
    named = features(F.col("match"), F.col("before"))
    rows = one.distinct().select("label", F.pmod(F.xxhash64("match", "before"), F.lit(5)).alias("fold"), *[c.alias(k) for k, c in named.items()])
    rows = stage(rows.groupBy(*rows.columns).agg(F.count("*").cast("double").alias("weight")).orderBy(*rows.columns), "pii-vectors")
    chance = fit_trees(rows.where("fold > 0"), FEATURES, "label", weight="weight", trees=trees, depth=depth)
    base = F.concat(*[F.col(k) for k in KINDS]).alias("base")
    if chance is None:
        return scan.select("doc_id", base, F.array().cast(SPAN).alias("extra"))
    least = _threshold(rows.where("fold = 0").select("label", "weight", chance({k: F.col(k) for k in FEATURES}).alias("p")), precision)
    fresh = F.filter(labels, lambda x: ~x["known"])
    described = F.transform(fresh, lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"), *[c.alias(k) for k, c in features(x["match"], x["before"]).items()]))
    scored = F.transform(described, lambda x: F.struct(x["low"].alias("low"), (-x["high"]).alias("last"), chance({k: x[k] for k in FEATURES}).alias("p")))
    likely = F.array_sort(F.filter(scored, lambda x: x["p"] >= least))
    nothing = F.lit(None).cast("bigint")

    def keep(acc: Column, x: Column) -> Column:
        new = x["low"] >= acc["end"]
        return F.struct(F.when(new, -x["last"]).otherwise(acc["end"]).alias("end"), F.when(new, x["low"]).otherwise(nothing).alias("low"))

    kept = scanned(likely, F.struct(F.lit(0).cast("bigint").alias("end"), nothing.alias("low")), keep)
    kept = F.transform(F.filter(kept, lambda x: x["low"].isNotNull()), lambda x: F.struct(F.lit("likely").alias("kind"), F.lit(len(KINDS)).alias("rank"), x["low"].alias("low"), x["end"].alias("high")))
    none = F.array().cast(SPAN)
    return scan.select("doc_id", base, F.when(F.size("found") > 0, kept.cast(SPAN)).otherwise(none).alias("extra"))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _threshold(scored: DataFrame, precision: float) -> float:
    """The lowest of 100 score steps from which up the precision holds; over 1, so nothing passes, if none does."""
    steps = scored.groupBy(F.floor(F.col("p") * 100).cast("int").alias("step")).agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n")).collect()  # 101 rows at most
    best, good, n = 2.0, 0.0, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        good, n = good + r["good"], n + r["n"]
        if good >= precision * n:
            best = r["step"] / 100
    return best


def pii_report(docs: DataFrame, **options) -> DataFrame:
    """The counts, digest and span list that the contract names."""
    found = find_pii(docs, **options)
    return found.select("doc_id", *[count_kind("base", k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "extra")).alias("spans"), F.size("extra").cast("long").alias("n_likely"))
