"""The registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proctrace.llm import ann, decontamination, jaccard, lines, minhash, mixing, negatives, oracles, pii, ranking, secrets, substrings, toxicity, warc
from proctrace.llm.common import new_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op1_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


QUERIES["op1_warc_reassembly"] = op1_warc_reassembly


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.documents.select("doc_id", "size", "source_size", "target", "taken")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key", "spans")


QUERIES |= {"op2_source_mix": op2_source_mix, "op3_decontaminate": op3_decontaminate}


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


QUERIES["op8_secret_scan"] = op8_secret_scan


def op9_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


QUERIES["op9_pii_boosting"] = op9_pii_boosting


def op7_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES["op7_ann_search"] = op7_ann_search


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES["op5_toxicity"] = op5_toxicity


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents")).drop("text_key")


QUERIES["op4_ngram_jaccard"] = op4_ngram_jaccard


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)


QUERIES["op10_repeated_bytes"] = op10_repeated_bytes


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


QUERIES["op6_line_dedup"] = op6_line_dedup



def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES["op11_hard_negatives"] = op11_hard_negatives


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op12_ranked_search"] = op12_ranked_search
QUERIES["op13_minhash_dedup"] = op13_minhash_dedup

ORACLES |= {"op1_warc_reassembly": oracles.WARC, "op3_decontaminate": oracles.DECONTAMINATION, "op4_ngram_jaccard": oracles.JACCARD, "op6_line_dedup": oracles.LINES, "op10_repeated_bytes": oracles.SUBSTRINGS, "op11_hard_negatives": oracles.NEGATIVES, "op12_ranked_search": oracles.RANKING, "op13_minhash_dedup": oracles.MINHASH}
