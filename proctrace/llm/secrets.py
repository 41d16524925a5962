"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Base spans are matches of the patterns of ``BASE`` that pass their length test. The method adds
spans of kind ``entropy``: candidates are long runs of key characters that hold a digit; in
each, the Shannon entropy of a window of ``window`` characters is followed by incremental
counts (one character enters, one leaves, and the sum of c * log2(c) changes by two terms). The
span runs from the first to the last window whose entropy reaches the threshold of the
candidate's character class. Candidates on the allow-list (numbers and dates, UUIDs, paths and
dotted names, few distinct characters, words repeated) are suppressed; base spans never are.

Only DataFrame functions are used; windows of a candidate are folded within its row.

Defined cases: a null text is empty; empty texts have no spans; each row gives a row, repeated or
not; a null id stays null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proctrace.llm.common import bound
from proctrace.llm.spans import SPAN, labelled, listed, matches

#: Fixed by the contract: kind, pattern, group that is measured, least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", None, 16),
    ("hex", r"[0-9a-f]{32,}+", None, 32),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}+"
#: The characters of candidates.
KEY = string.ascii_letters + string.digits + "+/_=-"
#: Character classes in order, with the least entropy in bits of a window.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("alnum", r"^[A-Za-z0-9]+$", 3.7), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.9))
ALLOWED = (
    r"^[0-9_/+=-]+$",
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^[/_=+-]*+[A-Za-z]++(?:[/_=+-]++(?:[A-Za-z]++|[0-9]{1,8}+))*+[/_=+-]*+$",
    r"^(.{1,6})\1{3,}",
)


def window_entropy(text: Column, window: int) -> Column:
    """(first, last) starts, from 0, of windows that reach the text's threshold; null where none does.

    text: a struct (match, least). Counts of the characters of ``KEY`` are small numbers, packed
    into a few longs, so a step costs the same at any length.
    """
    bits = (window + 1).bit_length()
    per = 63 // bits  # counters in a long
    terms = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(window + 2)])
    place = F.array(*[F.lit(KEY.find(chr(c))) for c in range(128)])
    words = -(-len(KEY) // per)
    word_of = F.array(*[F.lit(k // per) for k in range(len(KEY))])
    shift_of = F.array(*[F.lit(k % per * bits) for k in range(len(KEY))])
    unit_of = F.array(*[F.lit(1 << (k % per * bits)).cast("long") for k in range(len(KEY))])
    term = lambda c: F.get(terms, c)

    def count(counts: Column, k: Column) -> Column:
        shifted = F.call_function("shiftright", F.get(counts, F.get(word_of, k)), F.get(shift_of, k))
        return shifted.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def fold(codes: Column) -> Column:
        def moved(acc: Column, x: Column) -> Column:
            """x: what enters and leaves, -1 for nothing, and the counts of both before."""
            enters, leaves = x["enters"], x["leaves"]
            total = acc["total"] + F.when(leaves < 0, 0.0).otherwise(term(x["less"] - 1) - term(x["less"])) + term(x["more"] + 1) - term(x["more"])
            into, out = F.get(word_of, enters), F.when(leaves < 0, -1).otherwise(F.get(word_of, leaves))
            plus = lambda w: F.when(w == into, F.get(unit_of, enters)).otherwise(F.lit(0).cast("long"))
            minus = lambda w: F.when(w == out, F.get(unit_of, leaves)).otherwise(F.lit(0).cast("long"))
            counts = F.transform(acc["counts"], lambda c, w: c + plus(w) - minus(w))
            return F.struct(F.when(enters == leaves, acc["counts"]).otherwise(counts).alias("counts"), F.when(enters == leaves, acc["total"]).otherwise(total).alias("total"))

        def step(acc: Column, i: Column) -> Column:
            leaves = F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))
            x = F.struct(F.get(codes, i).alias("enters"), leaves.alias("leaves"))
            x = bound(x, lambda x: F.struct(x["enters"], x["leaves"], count(acc["counts"], x["enters"]).alias("more"), F.when(x["leaves"] < 0, 0).otherwise(count(acc["counts"], x["leaves"])).alias("less")))

            def after(new: Column) -> Column:
                hit = (i >= window - 1) & (F.lit(math.log2(window) + 1e-12) - new["total"] / window >= text["least"])
                first = F.when(hit & acc["first"].isNull(), i - window + 1).otherwise(acc["first"])
                return F.struct(new["counts"].alias("counts"), new["total"].alias("total"), first.alias("first"), F.when(hit, i - window + 1).otherwise(acc["last"]).alias("last"))

            return bound(bound(x, lambda x: moved(acc, x)), after)

        none = F.lit(None).cast("int")
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0.0).alias("total"), none.alias("first"), none.alias("last"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return bound(F.transform(F.split(text["match"], ""), lambda c: F.get(place, F.ascii(c))), fold)


def _long_enough(found: Column, least: int) -> Column:
    return F.filter(found, lambda x: F.char_length(x["part"]) >= least)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """(doc_id, base, extra): arrays of spans (kind, rank, low, high), a row per document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    base = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        base.append(labelled(_long_enough(matches(F.col("text"), pattern, group), least), kind, rank))
    long = F.filter(matches(F.col("text"), CANDIDATE), lambda x: x["match"].rlike("[0-9]") & ~x["match"].rlike("|".join(ALLOWED)))
    least = lambda m: F.coalesce(*[F.when(m.rlike(p), F.lit(bits)) for _, p, bits in CLASSES])
    entropy = lambda x: bound(F.struct(x["match"].alias("match"), least(x["match"]).alias("least")), lambda t: window_entropy(t, window))
    scanned = F.transform(long, lambda x: F.struct(x["low"].alias("low"), entropy(x).alias("w")))
    scanned = F.filter(scanned, lambda x: x["w"]["first"].isNotNull())
    extra = F.transform(scanned, lambda x: F.struct(F.lit("entropy").alias("kind"), F.lit(len(BASE)).alias("rank"), (x["low"] + x["w"]["first"]).alias("low"), (x["low"] + x["w"]["last"] + window).alias("high")))
    return out.select("doc_id", F.concat(*base).cast(SPAN).alias("base"), extra.cast(SPAN).alias("extra"))


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """The counts, digest and span list that the contract names."""
    found = find_secrets(docs, **options)
    return found.select("doc_id", *[count_kind("base", k).alias(f"n_{k}") for k, *_ in BASE], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "extra")).alias("spans"), F.size("extra").cast("long").alias("n_entropy"))
