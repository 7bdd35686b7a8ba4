"""Registered queries of the operators in this subpackage: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit, html_density, licenses, mixing, piece_scores, pieces, quality_embed, rules, sharding, simhash, spelling, topk, toxicity, vector_links
from .common import table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return add


@query("op1_quality_classifier")
def op1(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_embed.score_documents(docs, quality_embed.fit(docs, labels))


@query("op2_simhash_near_dedup")
def op2(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: A public SentencePiece model with byte pieces; read on the driver, never copied into the repository.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query("op10_sentencepiece_codec")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    vocabulary, _ = piece_scores.estimate(docs, pieces.Vocabulary.read(PIECE_MODEL))
    return pieces.encode_documents(docs, pieces.Codec(vocabulary))


@query("op6_mix_sources", mixing.ORACLE)
def op6(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op9_quality_rules", rules.ORACLE)
def op9(spark, sf_dir):
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_toxicity")
def op3(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_documents(docs, toxicity.fit(docs, labels))


@query("op8_html_main_text")
def op8(spark, sf_dir):
    return html_density.extract_pages(table(spark, sf_dir, "pages"))


@query("op4_license_scan")
def op4(spark, sf_dir):
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


@query("op7_balanced_shards")
def op7(spark, sf_dir):
    return sharding.balanced_shards(table(spark, sf_dir, "documents"))


@query("op5_exact_top_k", topk.ORACLE)
def op5(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op11_filter_audit", filter_audit.ORACLE)
def op11(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_embedding_near_dedup", vector_links.ORACLE)
def op12(spark, sf_dir):
    return vector_links.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op13_spelling_variants")
def op13(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
