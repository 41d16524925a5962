"""Mixing sources to target weights.

Every source's documents, in a fixed order, form a stream of words that is cut into blocks of
``block_words`` words. Each output shard draws how many of its slots go to each source: the
whole part of the expected count, and a multinomial draw over the remaining parts. A source's
slots, numbered through the shards, run through its blocks in passes; in every pass a
pseudorandom permutation of block indices (an unbalanced Feistel network with cycle walking)
maps slot to block. Blocks are packed with their documents' words and joined with the slots by index,
which makes the rows of the output shards; what a document gives is counted from these rows. Slots beyond a source's target
are dropped, slots that the draws left over go to one closing shard, and the last slot is cut
at the word, so a source's taken words are its target rounded to a whole number.

Only DataFrame functions are used. A source may hold any share of the rows: positions in its
stream come from sums over (source, bucket), where buckets are hashes of documents. Texts are
shuffled twice, to their places and to their blocks; a block has ``block_words`` words. Sources
themselves are ranked in one task, a row for each. A shard has ``shard_slots`` slots, more where there would
be over ``most_shards`` shards.

Defined cases: a null text has no words; documents without words take nothing; a null source is
a source of its own, ordered last; repeated rows are documents of their own; an empty table
gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proctrace.llm.common import SPACE_WORD, bound, stage, text_key


class Mixture(NamedTuple):
    """documents: a row per document; slots: (shard, slot of the source, block, words taken of it).

    shards: the mix itself, a row per slot with its words, one space between them, and the parts of
    which document (doc_id, and start, its place in its source's stream) they are: words low to high.
    """

    sources: DataFrame
    slots: DataFrame
    shards: DataFrame
    documents: DataFrame


def _unit(*cols: Column) -> Column:
    """A pseudorandom number in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / float(1 << 52)


def _permuted(x: Column, n: Column, key: Column, rounds: int = 4, walks: int = 24) -> Column:
    """A bijection of 0 .. n-1 that depends on key.

    The network works on a grid of a rows and b columns just large enough for n. What lands
    beyond n is sent through again; over grids where that could take more than ``walks`` steps
    its probability is under 1e-30.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def step(v: Column) -> Column:
        left, right = F.floor(v / b).cast("long"), F.pmod(v, b)
        for r in range(rounds):
            if r % 2 == 0:
                left = F.pmod(left + F.pmod(F.xxhash64(key, F.lit(r), right), a), a)
            else:
                right = F.pmod(right + F.pmod(F.xxhash64(key, F.lit(r), left), b), b)
        return left * b + right

    return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), step(x), lambda acc, _: F.when(acc < n, acc).otherwise(step(acc)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """sizes (skey, source_size) -> rank, weight and target of each source; one row per source.

    target = min(cap * size, level * weight), where the level makes targets sum to all sizes:
    with sources ordered by cap * size / weight it is the largest, over the order, of what the
    earlier ones leave divided by the weights that remain.
    """
    rank = F.row_number().over(W.orderBy("skey")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", rank).withColumn("weight", weight).withColumn("most", (cap * F.col("source_size")).cast("double"))
    order = W.orderBy(F.col("most") / F.col("weight"), "rank")
    rest = order.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(whole) - before) / F.sum("weight").over(rest)
    return ranked.withColumn("level", level).withColumn("target", F.least("most", F.max("level").over(whole) * F.col("weight"))).drop("most", "level")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block_words: int = 256, shard_slots: int = 4096, most_shards: int = 16_384, buckets: int = 1024, seed: int = 17) -> Mixture:
    source = F.col(source_col).cast("string")
    skey = F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("skey")
    texts = docs.select(F.col(id_col).alias("doc_id"), skey, F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key")).withColumn("row_key", F.xxhash64("doc_id", "skey", "text_key"))
    counted = F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size")
    sizes = stage(texts.select("doc_id", "skey", counted, "text_key", "row_key", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(buckets)).alias("bucket")), "mix-sizes")
    b = F.lit(block_words)

    # one row per source, then per (source, bucket)
    by_bucket = stage(sizes.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    targets = source_targets(by_bucket.groupBy("skey").agg(F.sum("bucket_size").alias("source_size")), weights, cap)
    size, words = F.col("source_size"), F.col("target_words")
    targets = (
        targets.withColumn("target_words", F.round("target").cast("long"))
        .withColumn("full", F.floor(size / b).cast("long"))
        .withColumn("blocks", F.ceil(size / b).cast("long"))
        .withColumn("passes", F.when(size > 0, F.floor(words / size).cast("long")).otherwise(0))
        .withColumn("slots", F.when(size > 0, F.col("passes") * F.col("blocks") + F.ceil((words - F.col("passes") * size) / b)).otherwise(0).cast("long"))
    )
    whole = W.partitionBy(F.lit(1))
    targets = targets.withColumn("all_slots", F.sum("slots").over(whole))
    per_shard = F.greatest(F.lit(shard_slots), F.ceil(F.col("all_slots") / most_shards)).cast("long")
    targets = targets.withColumn("per_shard", per_shard).withColumn("shards", F.ceil(F.col("all_slots") / F.col("per_shard")).cast("long"))
    # what one shard expects of a source: of whole shards (kind 0) and of the last one (kind 1)
    last = F.col("all_slots") - (F.col("shards") - 1) * F.col("per_shard")
    for kind, n in ((0, F.col("per_shard")), (1, last)):
        expected = F.when(F.col("all_slots") > 0, n * F.col("slots") / F.col("all_slots")).otherwise(0.0)
        targets = targets.withColumn(f"whole{kind}", F.floor(expected).cast("long")).withColumn(f"part{kind}", expected - F.floor(expected))
        targets = targets.withColumn(f"left{kind}", n - F.sum(f"whole{kind}").over(whole)).withColumn(f"sum{kind}", F.sum(f"part{kind}").over(whole))
        below = F.coalesce(F.sum(f"part{kind}").over(W.partitionBy(F.lit(1)).orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        targets = targets.withColumn(f"low{kind}", F.when(F.col(f"sum{kind}") > 0, below / F.col(f"sum{kind}")).otherwise(1.0))
        targets = targets.withColumn(f"high{kind}", F.lead(f"low{kind}", 1, 1.0).over(W.partitionBy(F.lit(1)).orderBy("rank")))
    sources = stage(targets, "mix-sources")

    slots = _slots(sources, block_words, seed)
    # where each document lies in its source's stream
    offsets = (
        by_bucket.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .join(sources.select("skey", "rank", "source_size", "target"), "skey")
        .select("skey", "bucket", "bucket_start", "rank", "source_size", "target")
    )
    within = W.partitionBy("skey", "bucket").orderBy("doc_id", "text_key").rowsBetween(W.unboundedPreceding, 0)
    placed = sizes.withColumn("upto", F.sum("size").over(within)).join(offsets, ["skey", "bucket"]).withColumn("start", F.col("bucket_start") + F.col("upto") - F.col("size"))
    placed = stage(placed.select("doc_id", "text_key", "row_key", "rank", "size", "source_size", "target", "start"), "mix-placed")
    shards = stage(_filled(slots, _packed(texts, placed, block_words)), "mix-shards")
    parts = shards.select("rank", F.explode("parts").alias("part")).groupBy("rank", "part.start").agg(F.sum(F.col("part.high") - F.col("part.low")).alias("taken"))
    taken = placed.where("size > 0").join(parts.hint("merge"), ["rank", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    own = ["doc_id", "text_key", "rank", "size", "source_size", "target", "start", "taken"]
    taken = taken.select(own).unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(own))
    return Mixture(sources, slots, shards, taken)


def _packed(texts: DataFrame, placed: DataFrame, block_words: int) -> DataFrame:
    """(rank, block, words, parts): every block with its words in order and the documents they are of.

    Rows alike in source, id and text lie side by side in the stream: the first one's place and
    their number give each its own.
    """
    b = F.lit(block_words).cast("long")
    alike = W.partitionBy("row_key", "text_key").orderBy("row_key")
    places = placed.where("size > 0").groupBy("row_key", "text_key").agg(F.min("start").alias("begin"), F.min("rank").alias("rank"), F.min("size").alias("size"))
    rows = texts.join(places.hint("merge"), ["row_key", "text_key"])
    rows = rows.withColumn("start", F.col("begin") + (F.row_number().over(alike) - 1) * F.col("size")).withColumn("end", F.col("start") + F.col("size"))

    def part(words: Column, block: Column) -> Column:
        low, high = F.greatest(F.col("start") - block * b, F.lit(0)), F.least(F.col("end") - block * b, b)
        first = (block * b + low - F.col("start") + 1).cast("int")
        return F.struct(block.alias("block"), low.alias("low"), high.alias("high"), F.array_join(F.slice(words, first, (high - low).cast("int")), " ").alias("text"))

    blocks = F.sequence(F.floor(F.col("start") / b).cast("long"), F.floor((F.col("end") - 1) / b).cast("long"))
    cut = bound(F.regexp_extract_all("text", F.lit(SPACE_WORD), F.lit(0)), lambda words: F.transform(blocks, lambda block: part(words, block)))
    pieces = rows.select("rank", "doc_id", "start", F.explode(cut).alias("piece")).select("rank", "piece.block", "piece.low", "piece.high", "doc_id", "start", "piece.text")
    packed = pieces.repartition("rank", "block").groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("low", "high", "doc_id", "start", "text"))).alias("all"))
    return packed.select("rank", "block", F.array_join("all.text", " ").alias("packed"), F.transform("all", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["low"].alias("low"), x["high"].alias("high"))).alias("parts"))


def _filled(slots: DataFrame, blocks: DataFrame) -> DataFrame:
    """Slots joined with their blocks by index, cut at the words that they take."""
    rows = blocks.join(slots.hint("merge"), ["rank", "block"])
    words = F.col("words")
    parts = F.transform(F.filter("parts", lambda x: x["low"] < words), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["low"].alias("low"), F.least(x["high"], words).alias("high")))
    return rows.select("rank", "shard", "slot", "block", words, F.expr("substring_index(packed, ' ', cast(words as int))").alias("text"), parts.alias("parts"))


def _slots(sources: DataFrame, block_words: int, seed: int, cells: int = 1024) -> DataFrame:
    """(rank, shard, slot, block, words): each slot of the mix with the block it takes and how many of its words."""
    key = F.lit(seed)
    shard = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))
    live = sources.where("shards > 0")
    whole = live.select("rank", "shards", "whole0", "whole1", shard.alias("shard"))
    whole = whole.select("rank", "shard", F.when(F.col("shard") == F.col("shards") - 1, F.col("whole1")).otherwise(F.col("whole0")).alias("n"))

    # multinomial draws for the slots that whole parts leave: u falls into one source's interval,
    # found by the cells that the interval touches
    draws = live.where("rank = 0").select("shards", "left0", "left1", shard.alias("shard"))
    draws = draws.withColumn("kind", F.when(F.col("shard") == F.col("shards") - 1, 1).otherwise(0)).withColumn("left", F.when(F.col("kind") == 1, F.col("left1")).otherwise(F.col("left0")))
    draws = draws.where("left > 0").select("kind", "shard", F.explode(F.sequence(F.lit(1).cast("long"), F.col("left"))).alias("draw"))
    draws = draws.withColumn("u", _unit(key, F.lit("draw"), F.col("shard"), F.col("draw"))).withColumn("cell", F.floor(F.col("u") * cells).cast("long"))
    spans = None
    for kind in (0, 1):
        low, high = F.col(f"low{kind}"), F.col(f"high{kind}")
        one = live.where(high > low).select("rank", F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"))
        spans = one if spans is None else spans.unionByName(one)
    touched = F.sequence(F.floor(F.col("low") * cells).cast("long"), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)).cast("long"))
    spans = spans.withColumn("cell", F.explode(touched))
    drawn = draws.join(spans, ["kind", "cell"]).where("u >= low and u < high").groupBy("rank", "shard").agg(F.count("*").alias("n"))

    counts = whole.unionByName(drawn).groupBy("rank", "shard").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, 0))
    runs = counts.withColumn("first", upto - F.col("n"))
    closing = counts.groupBy("rank").agg(F.sum("n").alias("first")).join(live.select("rank", "slots", "shards"), "rank").where("slots > first").select("rank", F.col("shards").alias("shard"), (F.col("slots") - F.col("first")).alias("n"), "first")
    runs = runs.unionByName(closing.select(*runs.columns))

    slots = runs.join(live.select("rank", "slots", "blocks", "full", "source_size", "target_words"), "rank")
    slots = slots.withColumn("n", F.least("n", F.col("slots") - F.col("first"))).where("n > 0")
    # few small rows become many slots: as many tasks as a shuffle has, not as their bytes suggest
    slots = slots.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rank", "shard")
    slots = slots.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    slots = slots.withColumn("pass", F.floor(F.col("slot") / F.col("blocks")).cast("long")).withColumn("at", F.pmod("slot", "blocks"))
    # the block that is shorter, if any, ends each pass
    chosen = _permuted(F.col("at"), F.col("full"), F.xxhash64(key, F.col("rank"), F.col("pass")))
    slots = slots.withColumn("block", F.when(F.col("at") < F.col("full"), chosen).otherwise(F.col("full")))
    long = F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * block_words)
    left = F.col("target_words") - F.col("pass") * F.col("source_size") - F.col("at") * block_words
    return slots.select("rank", "shard", "slot", "block", F.least(long, left).alias("words"))
