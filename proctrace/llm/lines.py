"""Line dedup: exact set-similarity join of lines, later matches removed.

A line is the set of its words. Words are ordered by rarity: their counts over all documents,
in ``buckets`` hashed counters, are ranked and put in classes, the rarest first, then by hash.
Lines of the same text are one, numbered in the order of their first places (document id, text, line), so of
two similar lines the one of larger number goes; other copies of a line go in any case. What is asked for is whether a line has any
earlier similar one, not all pairs; lines are settled in two turns:

1. Pivots. Lines that share a min-hash of their words, or the second rarest, are held against the first among them:
   a few pairs for each line, whatever the size of its group. Lines similar to it are settled.
2. Prefix join. Of two lines x and y, |y| <= |x|, of Jaccard similarity t = num / den or more, at least
   o = t / (1 + t) * (|x| + |y|) words are common, so the first |x| - o + 1 words of x and the first
   |y| - o + 1 of y share one (prefix filter). Lines are joined on those words and on size bands (length
   filter; y is in the band of x or the one below, and its prefix follows from the least size that x
   has there). In the join itself pairs pass bounds on lengths, on the shared word's
   positions (what can still be common after it) and on parity sketches (bits that differ are fewer
   than words that differ), and the later line must not be settled yet; so groups of similar
   lines don't come as all their pairs.

Pairs of both turns are verified on the words; of the second turn first the ``TRIES`` of each later line whose sketches
differ least, then the others of lines that these don't settle. Lines without words stay.

Only DataFrame functions are used.

Defined cases: a null text has no lines and stays null; lines are what line feeds separate; words
are compared as written; nothing but lines with words is removed; a null id comes last; repeated
rows count once, and have the same result, a row each; an empty table gives an empty result;
other columns, whatever their names, are kept by ``without_repeats`` and not read elsewhere.
"""

from __future__ import annotations

import functools
import math
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proctrace.llm.common import bound, discard, same_row, stage, text_key, unused

MASK = (1 << 56) - 1
#: Lines of more words have a sketch of 128 bits, the others one of 64.
WIDE = 48
#: A set's heads begin with two min-hashes, the least and the largest of its words' hashes; the prefix follows.
ENDS = 2
#: In large groups of near copies a line has many candidates, and most often one of the likeliest settles it.
TRIES = 4
#: Bits beside a word's position: the line isn't settled; the row stands for x; it stands for y.
LIVE, LARGER, SMALLER = 1 << 31, 1 << 30, 1 << 29


def _plain(text: Column) -> Column:
    """White space but line feeds as spaces; splitting by one plain character is several times faster than by a pattern."""
    others = "\t\x0b\x0c\r"
    return F.when(functools.reduce(or_, (text.contains(c) for c in others)), F.translate(text, others, "    ")).otherwise(text)


def _words(line: Column) -> Column:
    """The words of a line of plain text."""
    return F.array_remove(F.split(line, " "), "")


def _ranks(text: DataFrame, buckets: int) -> Column:
    """An array: for each bucket of word hashes the class of its count, in the top bits, as one constant."""
    words = text.select(F.explode(F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    counts = words.groupBy(_bucket(F.xxhash64("word"), buckets).alias("bucket")).count().collect()  # buckets rows at most
    ranks = [0] * buckets
    for rank, r in enumerate(sorted(counts, key=lambda r: (r["count"], r["bucket"]))):
        ranks[r["bucket"]] = (120 * rank // len(counts)) << 56
    return F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")


def _sketch(words: Column) -> Column:
    """64 parity bits of the words' hashes."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(x, 58).cast("int"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(bit(x)))


def _half(words: Column) -> Column:
    """Of lines of more than ``WIDE`` words, the parity bits of half of all words; with those of all, this makes 128 bits."""
    return F.when(F.size(words) > WIDE, _sketch(F.filter(words, lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 0)))


def _bucket(word_hash: Column, buckets: int) -> Column:
    return F.shiftrightunsigned(word_hash, 65 - buckets.bit_length())


def _places(base: DataFrame) -> DataFrame:
    """(id, doc_id, text_key, no), staged: the first place of each line of the same text, numbered in the order of places."""
    rows = base.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.ltrim("line") != "")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "no").alias("place")
    copies = rows.select(F.xxhash64("line").alias("a"), F.hash("line").alias("b"), F.octet_length("line").alias("c"), place)
    first = copies.groupBy("a", "b", "c").agg(F.min("place").alias("place")).orderBy("place")
    return stage(first.select(F.monotonically_increasing_id().alias("id"), "place.doc_id", "place.text_key", "place.no"), "line-places")


def _by_document(places: DataFrame, what: Column) -> DataFrame:
    """(id_key, text_key, lines): what each place has, by document; ids by their hashes, so that a null id is a key like others."""
    return places.groupBy(F.xxhash64("doc_id").alias("id_key"), "text_key").agg(F.collect_list(what).alias("lines"))


def _sets(base: DataFrame, places: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """(id, size, odd, half, heads, line), staged: what pairs of first lines are found and verified by."""
    ranks = _ranks(base, buckets)
    # rows repeated in the table are one document
    texts = base.groupBy(F.xxhash64("doc_id").alias("id_key"), "text_key").agg(F.first("text").alias("text"))
    held = texts.join(_by_document(places, F.struct("id", "no")), ["id_key", "text_key"])
    # a text is split once for all of its lines
    picked = bound(F.split("text", "\n"), lambda every: F.transform("lines", lambda x: F.struct(x["id"].alias("id"), F.get(every, x["no"]).alias("line"))))
    held = held.select(F.explode(picked).alias("x")).select("x.id", "x.line")
    rows = held.select("id", "line", F.array_distinct(F.transform(_words(F.col("line")), lambda x: F.xxhash64(x))).alias("hashes"))
    ranked = F.transform("hashes", lambda x: F.get(ranks, _bucket(x, buckets).cast("int")).bitwiseOR(x.bitwiseAND(F.lit(MASK))))
    ends = F.array(F.array_min("hashes"), F.array_max("hashes")).alias("ends")
    rows = rows.select("id", "line", F.size("hashes").alias("size"), _sketch(F.col("hashes")).alias("odd"), _half(F.col("hashes")).alias("half"), ends, F.sort_array(ranked).alias("words"))
    prefix = F.slice("words", F.lit(1), F.col("size") - F.ceil(F.col("size") * num / den).cast("int") + 1)
    return stage(rows.select("id", "size", "odd", "half", F.concat("ends", prefix).alias("heads"), "line"), "line-sets")


def repeated_lines(docs: DataFrame, *, num: int = 4, den: int = 5, buckets: int = 32_768, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, no): the lines to remove, by number from 0. buckets: a power of two."""
    base = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), _plain(F.col(text_col)).alias("text")).where("text is not null")
    places = _places(base)
    first = _sets(base, places, buckets, num, den)
    texts = first.select("id", "line")
    settled = _verified(texts, texts, _pivot_pairs(first, num, den), num, den)
    more = _verified(texts, texts, _prefix_pairs(first, settled, num, den), num, den)
    kept = stage(_by_document(places.join(settled.unionByName(more), "id", "left_anti"), F.col("no")), "line-kept")
    discard(places, first, settled, more)
    numbers = F.array_compact(F.transform(F.split("text", "\n"), lambda x, i: F.when(F.ltrim(x) != "", i)))
    rows = base.select(F.xxhash64("doc_id").alias("id_key"), "doc_id", "text_key", numbers.alias("all")).where(F.size("all") > 0)
    rows = rows.join(kept, ["id_key", "text_key"], "left")
    gone = F.when(F.col("lines").isNull(), F.col("all")).otherwise(F.array_except("all", "lines"))
    return rows.select("doc_id", "text_key", F.explode(gone).alias("no")).distinct()


def _differ(a: str, b: str) -> Column:
    """How many bits of two sketches (odd and half with these suffixes) differ."""
    odd, half = F.col(f"odd{a}").bitwiseXOR(F.col(f"odd{b}")), F.col(f"half{a}").bitwiseXOR(F.col(f"half{b}"))
    return F.coalesce(F.bit_count(half) + F.bit_count(odd.bitwiseXOR(half)), F.bit_count(odd))


def _alike(a: str, b: str, size_a: Column, size_b: Column, num: int, den: int) -> Column:
    """That sizes and sketches (odd and half with these suffixes) allow the similarity."""
    differ = _differ(a, b)
    return (F.least(size_a, size_b) * den >= F.greatest(size_a, size_b) * num) & (differ * (den + num) <= (size_a + size_b) * (den - num))


def _pivot_pairs(first: DataFrame, num: int, den: int) -> DataFrame:
    """(early, late): each line with the first of those that share a min-hash with it."""
    # the second rarest word is one more key: where lines differ in one rare word, that word comes first
    heads = F.filter(F.array(*[F.get("heads", F.lit(k)) for k in (*range(ENDS), ENDS + 1)]), lambda x: x.isNotNull())
    members = first.select("id", "odd", "half", "size", F.posexplode(heads).alias("turn", "least")).select("id", "odd", "half", "size", F.xxhash64("least", "turn").alias("key"))
    pivots = members.groupBy("key").agg(F.min(F.struct("id", "odd", "half", "size")).alias("p"), F.count("*").alias("n")).where("n > 1")
    pivots = pivots.select("key", F.col("p.id").alias("early"), F.col("p.odd").alias("odd_p"), F.col("p.half").alias("half_p"), F.col("p.size").alias("size_p"))
    both = members.join(pivots, "key").where(F.col("id") > F.col("early")).where(_alike("", "_p", F.col("size"), F.col("size_p"), num, den))
    return both.select("early", F.col("id").alias("late")).distinct()


def _prefix_pairs(first: DataFrame, settled: DataFrame, num: int, den: int) -> DataFrame:
    """(early, late, rate): candidates by prefix words, the late line not settled, and how much their sketches differ."""
    step = math.log(den / num * 1.01)
    # the least size of each band, as a constant: a lambda's result would be made anew for each line
    starts = F.array(*[F.lit(math.ceil(math.exp(k * step) - 1e-9)) for k in range(int(math.log(1 << 31) / step) + 3)])
    n = F.col("size")
    band = F.floor(F.log(n.cast("double")) / step + 1e-9).cast("int")
    # how many of its words stand for a line as y, the smaller one: beside an x of the same size or more, and one of the next band
    beside = lambda other: F.greatest(F.lit(0), n - F.ceil((n + other) * num / (den + num) - 1e-9).cast("int") + 1)
    rows = first.join(settled.withColumn("done", F.lit(True)), "id", "left")
    meta = F.shiftleft(n.cast("long"), 32) + F.when(F.col("done").isNull(), LIVE).otherwise(0)
    rows = rows.select("id", "odd", "half", meta.alias("meta"), band.alias("band"), beside(n).alias("own"), beside(F.get(starts, band + 1)).alias("next"), F.slice("heads", F.lit(ENDS + 1), F.size("heads") - ENDS).alias("prefix"))
    # one turn for both bands: after the whole prefix comes what stands for the line as y in the next band
    places = F.posexplode(F.concat("prefix", F.slice("prefix", F.lit(1), F.col("next")))).alias("at", "word")
    index = rows.select("id", "odd", "half", "meta", "band", "own", F.size("prefix").alias("length"), places)
    above = F.col("at") >= F.col("length")
    at = F.col("at") - F.when(above, F.col("length")).otherwise(0)
    roles = F.when(above, SMALLER).otherwise(F.lit(LARGER) + F.when(F.col("at") < F.col("own"), SMALLER).otherwise(0))
    # narrow rows: size, roles and position are one number; both sides of the join are one shuffle
    key = F.xxhash64("word", F.col("band") + above.cast("int")).bitwiseAND(F.lit((1 << 40) - 1)).alias("key")
    index = index.select(key, "id", "odd", "half", (F.col("meta") + roles + at).alias("meta"))
    side = lambda s: index.select(*[F.col(c).alias(f"{c}_{s}") for c in index.columns])
    left, right = side("a"), side("b")
    has = lambda s, bit: F.col(f"meta_{s}").bitwiseAND(F.lit(bit))
    size_a, size_b = F.shiftright("meta_a", 32), F.shiftright("meta_b", 32)
    at = lambda s: F.col(f"meta_{s}").bitwiseAND(F.lit(SMALLER - 1))
    rest = F.least(size_a - at("a"), size_b - at("b"))
    ahead = F.col("id_a") < F.col("id_b")
    hope = (
        ((size_b < size_a) | ((size_b == size_a) & ahead))
        & (has("a", LARGER) + has("b", SMALLER) == LARGER + SMALLER)  # in one test, so that both sides keep all rows and share their shuffle
        & (F.when(ahead, has("b", LIVE)).otherwise(has("a", LIVE)) != 0)
        & _alike("_a", "_b", size_a, size_b, num, den)
        & (rest * (den + num) >= (size_a + size_b) * num)
    )
    both = left.join(right.hint("shuffle_hash"), (F.col("key_a") == F.col("key_b")) & hope)
    return both.select(F.least("id_a", "id_b").alias("early"), F.greatest("id_a", "id_b").alias("late"), (_differ("_a", "_b") / (size_a + size_b)).cast("float").alias("rate")).distinct()


def _verified(earlier: DataFrame, later: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The ids of late lines that are similar by their words to one they are paired with, as a staged table. earlier, later: (id, line).

    Where pairs have a rate, each late line's likeliest are verified first, and the others only if these don't settle it.
    """
    rated = "rate" in pairs.columns
    if rated:
        pairs = pairs.select("early", "late", (F.row_number().over(W.partitionBy("late").orderBy("rate", "early")) <= TRIES).alias("likely"))
        pairs = stage(pairs, "line-pairs")
    earlier, later = earlier.toDF("early", "early_line"), later.toDF("late", "late_line")
    x, y = (F.array_distinct(_words(F.col(c))).alias(c) for c in ("early_line", "late_line"))
    common = F.size(F.array_intersect("early_line", "late_line"))

    def similar(some: DataFrame) -> DataFrame:
        both = some.join(earlier, "early").join(later, "late").select("late", x, y)
        both = both.where(common * (den + num) >= (F.size("early_line") + F.size("late_line")) * num)
        return both.select(F.col("late").alias("id")).distinct()

    if not rated:
        return stage(similar(pairs), "line-settled")
    likely = stage(similar(pairs.where("likely")), "line-likely")
    others = similar(pairs.where("not likely").join(likely.withColumnRenamed("id", "late"), "late", "left_anti"))
    out = stage(likely.unionByName(others), "line-settled")
    discard(pairs, likely)
    return out


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): how many lines each document has, and which go, by number."""
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col, **options)
    gone = stage(gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("no")).alias("nos")), "line-removed")
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("text_key"), F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"))
    out = rows.join(gone, same_row(rows, gone), "left")
    return out.select(rows["doc_id"], "n_lines", F.coalesce(F.size("nos"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("nos").cast("array<string>"), ","), F.lit("")).alias("removed"))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = True, **options) -> DataFrame:
    """The documents without repeated lines, other columns as they were; those that lose all their words go, if asked."""
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col, **options)
    own_id, own_key, nos, new = unused(docs, "own_id", "own_key", "gone_nos", "new_text")
    gone = stage(gone.groupBy(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).agg(F.collect_list("no").alias(nos)), "line-removed")
    both = docs.join(gone, docs[id_col].eqNullSafe(gone[own_id]) & (text_key(docs[text_col]) == gone[own_key]), "left")
    lines = F.split(text_col, "\n")
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(nos))
    left = bound(lines, lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x, i)), "\n"))
    out = both.withColumn(new, F.when(F.col(nos).isNull(), F.col(text_col)).otherwise(left))
    if drop_emptied:
        out = out.where(F.col(nos).isNull() | F.col(new).rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col(new).alias(c) if c == text_col else docs[c] for c in docs.columns])
