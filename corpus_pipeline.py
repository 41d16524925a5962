"""From raw documents to a training mix: reject, deduplicate, decontaminate, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of documents.

Defined cases, in every stage: a null or empty text is a document without words, and stays; a
null id is an id of its own, ordered last; repeated rows have the same fate, and each that stays
is a row of its own; an empty table gives an empty result; other columns, whatever their names,
pass through unread. Each stage judges whole texts as its predecessor left them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proctrace.llm import decontamination, jaccard, lines, mixing, toxicity
from proctrace.llm.common import stage, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't reject; without labels of both classes all stay."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line resembles; those that lose all their words so go.

    Earlier is by document id, then text, then place, so of equal lines the first one stays.
    """
    return lines.without_repeats(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity 0.8 or more.

    The smallest id of a class stays. Documents without words are in no class.
    """
    return jaccard.one_of_each(docs, n=5, num=4, den=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate: fewer than a twentieth of their words are hit. An empty benchmark drops none."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its size, its source's size and target, and the words the mix takes of it.

    A null source is a source of its own, ordered last.
    """
    return mixing.mix_sources(docs).documents.select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("source_mix", mix),
]
#: The classifier's scores can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir).select(*[F.col(c) for c in docs.columns]), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
