"""Exact Jaccard join of documents on word n-grams, and its classes.

A document is the set of its distinct n-word shingles. Sets fall into size bands. Two sets of
similarity ``num / den`` or more whose larger one lies in a band differ in at most h elements, h
from the band's largest size. The band's hash partitions the universe into m segments, and d of
these allow one difference, with m + d = h + 1 + spare: by the pigeonhole principle segments
worth spare + 1 of the two are equal, or differ by one element and allow that. A set is indexed by its segments'
contents and, for the d segments, by those with one element deleted too. How many segments of
which kind a band gets is chosen by cost: signatures written plus accidental partners expected,
from the band's number of documents. A set is indexed in its own band and in those whose sets
it may be similar to. Empty segments match by accident, so they are left out; a set that
leaves out more than the band can spare is indexed under a second partition too, and under a
third, with empty segments, if need be: two similar sets that agree in nothing else both are.

Candidates are verified on the whole sets. Equal sets are one node. First, each node is held
against the smallest node of each signature; links found join nodes to classes, and only nodes
of different classes that share a signature are then held against each other, after bounds on
sizes and on parity sketches (bits that differ are fewer than elements that differ). So a group
of near copies costs a pair or a few for each member. Large sets fill a sketch of fixed length, so
they have a wide one too, of some bits an element, which pairs pass before texts are sent.

Elements are compared as 64-bit hashes, sets as 128-bit ones.

Defined cases: fewer words than n: the whole sequence is the one shingle; no words, or null: the
empty set, linked with nothing; a null id takes part, and a class's id is its smallest id that
isn't null; a document linked to none has its own id; repeated rows are equal sets; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proctrace.llm.bytes import binaries, mix, word_hashes
from proctrace.llm.common import SPACE_WORD, discard, same_row, stage, text_key, unused
from proctrace.llm.components import components

SKETCH = 16  # words of 64 bits


class Band(NamedTuple):
    least: int
    segments: int
    deletions: int
    spare: int  # how many segments' worth of empty ones the band can do without


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(n, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
    return np.unique(h)


def band_starts(most: int, growth: float) -> list[int]:
    """Least sizes of bands that hold sizes up to most, and what sets of that size are similar to."""
    out = [1]
    while out[-1] <= 2 * most:
        out.append(max(out[-1] + 1, int(out[-1] * growth)))
    return out


def allocate(starts: list[int], counts: dict[int, int], num: int, den: int, chance: float = 0.3, price: float = 4.0) -> list[Band]:
    """For each band the numbers of segments, of those with deletions and of spare ones that cost least.

    chance: how likely it is, for each element, that unlike sets agree in it by accident;
    price: what a pair costs, in signatures.
    """
    bands = []
    for b, least in enumerate(starts[:-1]):
        most, n = starts[b + 1] - 1, counts.get(b, 0)
        h = (2 * most * (den - num)) // (den + num)
        best = None
        for spare in sorted({*range(9), *(h * k // 40 for k in range(1, 13))}):
            for d in {0, 1, 2, 3, 4, (h + 1) // 4, (h + 1) // 2}:
                m = h + 1 + spare - d
                if d > m or (d and least < 3 * m):
                    continue
                per = least / m
                empty = (m + d * (2 + 2 * per)) * math.exp(-per)  # expected weight of what is left out
                again = 0.5 * math.erfc((spare + 0.5 - empty) / math.sqrt(2 * empty + 1e-9))  # that a set needs another partition
                hit = (m - d) * chance**per + d * (per + 1) * chance ** max(per - 1, 0)
                cost = n * (m + d * per) * (1 + again + again**2) + price * n * n / 2 * min(1.0, hit / m) * chance**6
                if best is None or cost < best[0]:
                    best = (cost, m, d, spare)
        bands.append(Band(least, *best[1:]))
    return bands


def signatures(s: np.ndarray, starts: list[int], bands: list[Band], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """What a set is indexed by, in its own band and in those of larger sets it may be similar to, with tags.

    A tag is the number of the list (band and partition), how many of the list's most common
    signatures of whole segments may be left out, and whether this is one of a whole segment.
    """
    if not len(s):
        return s, np.zeros(0, np.int32)
    out, tags = [], []
    own, far = bisect_right(starts, len(s)) - 1, bisect_right(starts, len(s) * den // num) - 1
    for b in range(own, far + 1):
        _, m, d, spare = bands[b]
        for turn in range(3):
            salt = np.uint64((b * 1_000_003 + turn * 7919 + 1) * 0xD1B54A32D192ED03 % (1 << 64))
            value = mix(s + salt)
            segment = (value >> np.uint64(33)) % np.uint64(m)
            element = mix(value)
            counts = np.bincount(segment.astype(np.int64), minlength=m)
            order = np.argsort(segment, kind="stable")
            sums = np.zeros(m, np.uint64)
            full = np.flatnonzero(counts)
            sums[full] = np.add.reduceat(element[order], np.concatenate(([0], np.cumsum(counts[full])[:-1])))
            tag = mix(np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt)
            use = np.arange(m) if turn == 2 else full
            # what is left out: empty segments, and of those with deletions the ones of one element too
            lost = (m - len(full)) + 2 * int((counts[:d] == 1).sum()) + int((counts[:d] == 0).sum())
            label = (b * 3 + turn) << 8 | min(127, max(0, spare - lost)) << 1
            out.append(mix(sums[use] + tag[use]))
            tags.append(label | (use >= d).astype(np.int32))
            if d:
                near = segment < np.uint64(d)
                if turn < 2:  # what a deletion empties is an empty segment
                    near &= counts[segment.astype(np.int64)] > 1
                at = segment[near].astype(np.int64)
                out.append(mix(sums[at] - element[near] + tag[at]))
                tags.append(np.full(len(at), label, np.int32))
            if lost <= spare:
                break
    return np.concatenate(out), np.concatenate(tags).astype(np.int32)


def sketch(s: np.ndarray) -> list[int]:
    bits = np.bincount((mix(s + np.uint64(77)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return [int(x) for x in np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)]


def wide_sketch(s: np.ndarray) -> bytes | None:
    """Parity bits, more than elements, of a set whose size fills a plain sketch; smaller ones do with that."""
    if len(s) <= 64 * SKETCH:
        return None
    width = 1 << len(s).bit_length()
    bits = np.bincount((mix(s + np.uint64(77)) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def parity_bits_apart(x: bytes, y: bytes) -> int:
    """Bits in which two wide sketches differ, the longer one folded to the length of the other."""
    short, long = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(long.reshape(-1, len(short)), axis=0) ^ short).sum())


def jaccard_classes(docs: DataFrame, *, n: int = 3, num: int = 9, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id), a row per document; similarity num / den."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key"))
    # sizes only guide the cost; counting words is near enough
    size = F.greatest(F.lit(1), F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)) - (n - 1))
    counts = base.groupBy(F.floor(F.log(size.cast("double")) * 16).cast("int").alias("step")).agg(F.count("*").alias("n"), F.max(size).alias("most")).collect()  # some hundred rows
    starts = band_starts(max((r["most"] for r in counts), default=1), 1.2 if 10 * num >= 9 * den else 1.3)
    by_band: dict[int, int] = {}
    for r in counts:
        b = bisect_right(starts, int(np.exp((r["step"] + 0.5) / 16))) - 1
        by_band[b] = by_band.get(b, 0) + r["n"]
    bands = allocate(starts, by_band, num, den)

    def links_of(sets: DataFrame, leads: DataFrame) -> DataFrame:
        # each distinct set once; rows that the table repeats come in pairs of the same id and text
        texts = stage(base.join(leads, same_row(base, leads)).select("node", "text").dropDuplicates(["node"]), "jac-texts")
        kept = _members(texts, starts, bands, n, num, den)
        links = _links(kept, kept, lambda involved: texts.join(involved, "node", "left_semi"), n, num, den)
        discard(texts)
        return links

    return classes(base, n, links_of)


def classes(base: DataFrame, n: int, links_of: Callable[[DataFrame, DataFrame], DataFrame], bands_of: Callable[[list[np.ndarray]], pa.Array] | None = None) -> DataFrame:
    """The classes of base (doc_id, text, text_key) by links of nodes, which are distinct sets.

    links_of: from the rows' sets (with bands, a column of longs that bands_of makes of sets, if
    given) and each node's leading row (node, doc_id, text_key) to links (a, b).
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            rows, found = [], []
            for text in binaries(part["text"]):
                s = shingles(text, n)
                total = int(mix(s).sum(dtype=np.uint64)) if len(s) else 0
                second = int(mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)) if len(s) else 0
                rows.append((len(s), *mix(np.array([total, second], np.uint64) + np.uint64(len(s))).view(np.int64).tolist()))
                found.append(s)
            columns = [part["doc_id"], part["text_key"], *[pa.array(c, pa.int64()) for c in zip(*rows)]]
            names = ["doc_id", "text_key", "n_shingles", "node", "node2"]
            if bands_of:
                columns, names = [*columns, bands_of(found)], [*names, "bands"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    id_type = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, text_key long, n_shingles long, node long, node2 long" + (", bands array<long>" if bands_of else "")
    sets = stage(base.mapInArrow(describe, schema), "jac-rows")
    lead = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    nodes = stage(sets.where("n_shingles > 0").groupBy("node", "node2", "n_shingles").agg(F.min(lead).alias("lead"), F.min("doc_id").alias("least")), "jac-nodes")
    leads = nodes.select("node", F.col("lead.doc_id").alias("doc_id"), F.col("lead.text_key").alias("text_key"))
    links = links_of(sets, leads)
    roots = components(links)
    named = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    class_id = stage(named.groupBy("root").agg(F.min("least").alias("class_id")), "jac-class")
    member = stage(named.join(class_id, "root").select("node", "class_id"), "jac-member")
    discard(nodes, class_id)
    rows = sets.select("doc_id", "text_key", "n_shingles", "node")
    out = rows.join(member, "node", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("class_id")).alias("component_id"))


def _parts(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of batches with texts of about most bytes."""
    for batch in batches:
        at, held = 0, 0
        for i, size in enumerate(pc.binary_length(batch["text"]).fill_null(0).to_pylist()):
            held += size
            if held >= most or i + 1 == batch.num_rows:
                yield batch.slice(at, i + 1 - at)
                at, held = i + 1, 0


def _members(texts: DataFrame, starts: list[int], bands: list[Band], n: int, num: int, den: int) -> DataFrame:
    """(sig, node): signatures that several sets share and none can leave out."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 1 << 18):
            found = [signatures(shingles(t, n), starts, bands, num, den) for t in binaries(part["text"])]
            node = np.repeat(part["node"].to_numpy(), [len(x) for x, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in found]).view(np.int64)), pa.array(node), pa.array(np.concatenate([t for _, t in found]))], names=["sig", "node", "tag"])

    rows = texts.mapInArrow(index, "sig long, node long, tag int")
    every = W.partitionBy("sig")
    rows = rows.withColumn("n", F.count("*").over(every)).withColumn("low", F.min("node").over(every)).withColumn("high", F.max("node").over(every))
    shared = stage(rows.where("low < high").select("sig", "node", "tag", "n"), "jac-shared")
    # the most common ones that each list can do without
    whole = F.col("tag") % 2 == 1
    slack = F.shiftright("tag", 1).bitwiseAND(F.lit(127))
    order = W.partitionBy("node", F.shiftright("tag", 8)).orderBy(F.desc(whole), F.desc("n"), F.desc("sig"))
    kept = stage(shared.withColumn("no", F.row_number().over(order)).where(~whole | (F.col("no") > slack)).select("sig", "node"), "jac-kept")
    discard(shared)
    return kept


def _links(kept: DataFrame, source: DataFrame, texts_of: Callable[[DataFrame], DataFrame], n: int, num: int, den: int) -> DataFrame:
    """(a, b): verified links that join all nodes of a class.

    kept: (sig, node), from the staged table source, which is used up. texts_of: from nodes to their (node, text).
    """
    pivots = kept.groupBy("sig").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).where("pivot < other").drop("other")
    members = stage(kept.join(pivots, "sig"), "jac-members")
    discard(source)
    involved = stage(members.select("node").distinct(), "jac-involved")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for part in _parts(batches):
            found = [shingles(t, n) for t in binaries(part["text"])]
            yield pa.RecordBatch.from_arrays([part["node"], pa.array([len(s) for s in found], pa.int64()), pa.array([sketch(s) for s in found], pa.list_(pa.int64())), pa.array([wide_sketch(s) for s in found], pa.binary()), pa.array(map(pack, binaries(part["text"])), pa.binary())], names=["node", "size", "sketch", "wide", "packed"])

    sets = stage(texts_of(involved).mapInArrow(elements, "node long, size long, sketch array<long>, wide binary, packed binary"), "jac-elements")
    discard(involved)
    sizes = sets.select("node", "size", "sketch")
    pairs = members.where("node <> pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n_sigs"))
    hopeful = stage(_bounded(pairs, sizes, num, den), "jac-hopeful")
    # a node's likeliest partner first: near copies are mostly settled by that
    best = hopeful.groupBy("b").agg(F.max_by("a", F.struct("n_sigs", "a")).alias("a")).select("a", "b")
    links = _verified(best, sets, n, num, den)
    roots = components(links)
    links = links.unionByName(_verified(_unlike(hopeful.select("a", "b"), roots), sets, n, num, den))
    discard(hopeful)

    # what shares a signature and is still of different classes
    roots = components(links)
    tagged = members.join(roots, "node", "left").select("sig", "node", "pivot", F.coalesce("root", "node").alias("root"))
    mixed = tagged.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high and n > 2").select("sig")
    opened = tagged = stage(tagged.join(mixed, "sig"), "jac-open")
    discard(members)
    own = tagged.groupBy("node").agg(F.collect_set("sig").alias("sigs"))
    tagged = tagged.join(own, "node").join(sizes, "node")
    left = tagged.select("sig", F.col("node").alias("a"), F.col("pivot"), F.col("root").alias("ra"), F.col("size").alias("sa"), F.col("sketch").alias("ka"), F.col("sigs").alias("ga"))
    right = tagged.select("sig", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("size").alias("sb"), F.col("sketch").alias("kb"), F.col("sigs").alias("gb"))
    # a pair comes from one of the signatures that it shares
    once = F.col("sig") == F.array_min(F.array_intersect("ga", "gb"))
    cross = left.join(right, "sig").where("a < b and ra <> rb and a <> pivot").where(_hope(num, den) & once).select("a", "b").distinct()
    links = links.unionByName(_verified(cross, sets, n, num, den))
    discard(opened, sets)
    return links


def _hope(num: int, den: int):
    """That sizes sa, sb and sketches ka, kb allow the similarity."""
    differ = sum((F.bit_count(F.col("ka")[i].bitwiseXOR(F.col("kb")[i])) for i in range(SKETCH)), F.lit(0))
    both = F.col("sa") + F.col("sb")
    return (F.least("sa", "sb") * den >= F.greatest("sa", "sb") * num) & (differ * (den + num) <= both * (den - num))


def _bounded(pairs: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    left = sizes.select(F.col("node").alias("a"), F.col("size").alias("sa"), F.col("sketch").alias("ka"))
    right = sizes.select(F.col("node").alias("b"), F.col("size").alias("sb"), F.col("sketch").alias("kb"))
    return pairs.join(left, "a").join(right, "b").where(_hope(num, den)).select("a", "b", "n_sigs")


def _unlike(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose nodes aren't known to be of one class."""
    left, right = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    out = pairs.join(left, "a", "left").join(right, "b", "left")
    return out.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _close(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose wide sketches, where both have one, allow the similarity."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(batch[c].to_pylist() for c in ("sa", "sb", "wa", "wb")))
            keep = [x is None or y is None or parity_bits_apart(x, y) * (den + num) <= (sa + sb) * (den - num) for sa, sb, x, y in both]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("size").alias("sa"), F.col("wide").alias("wa"))
    right = sets.select(F.col("node").alias("b"), F.col("size").alias("sb"), F.col("wide").alias("wb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", "wa", "wb").mapInArrow(fit, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Pairs whose whole sets are similar, as a staged table. Texts travel compressed: a third of the size of their hashed shingles."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keep = []
            for x, y in zip(binaries(batch["pa"]), binaries(batch["pb"])):
                x, y = shingles(unpack(x), n), shingles(unpack(y), n)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    close = stage(_close(pairs, sets, num, den), "jac-close")
    left = sets.select(F.col("node").alias("a"), F.col("packed").alias("pa"))
    right = sets.select(F.col("node").alias("b"), F.col("packed").alias("pb"))
    found = close.join(left, "a").join(right, "b").select("a", "b", "pa", "pb").mapInArrow(verify, "a long, b long")
    out = stage(found, "jac-links")
    discard(close)
    return out


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The first document of each class, by id, then text; all its columns as they were."""
    found = stage(jaccard_classes(docs, id_col=id_col, text_col=text_col, **options), "jac-rows")
    lead = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("text_key"))
    many = found.where("n_shingles > 0 and component_id is not null").groupBy("component_id").agg(F.min(lead).alias("lead"), F.count("*").alias("n")).where("n > 1")
    gone = found.where("n_shingles > 0").join(stage(many, "jac-many"), "component_id").where(~(F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("text_key") == F.col("lead.text_key"))))
    own_id, own_key = unused(docs, "own_id", "own_key")
    gone = gone.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone[own_id]) & (text_key(docs[text_col]) == gone[own_key]), "left_anti")
