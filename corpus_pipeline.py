"""The corpus pipeline: quality rules, quality classifier, near-duplicates, mixing, SentencePiece codes.

Each stage is (name, function of (spark, docs, sf_dir)) and works on what its predecessor kept; all but the last
return the columns of ``documents``.  Stages tolerate null ids and texts, repeated rows, empty tables and further columns
(see the operators' docstrings).  Labels are read from ``labels`` of ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contentlens.llm import mixing, piece_scores, pieces, quality_embed, rules, simhash
from contentlens.llm.common import cut, table
from contentlens.llm.queries import PIECE_MODEL


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep_documents(docs, table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labelled rows of the whole documents table, so that both classes are seen; applied to ``docs``."""
    model = quality_embed.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_embed.keep_documents(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


def piece_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Codes by piece probabilities of the texts that are encoded."""
    vocabulary, _ = piece_scores.estimate(docs, pieces.Vocabulary.read(PIECE_MODEL))
    return pieces.encode_documents(docs, pieces.Codec(vocabulary))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near-duplicates", near_duplicates),
    ("mix sources", mix_sources),
    ("piece codes", piece_codes),
]

#: A trained classifier, XXH64 fingerprints and piece codes have no SQL form; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents`` of ``sf_dir``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
