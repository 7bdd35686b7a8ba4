"""Registered end-to-end jobs (E1-E3) and the duplicate-similarity histogram (A4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import embed as EM
from ..operators import model as M
from ..operators import similarity as SIM
from ..operators import stats as S
from ..operators.holding import hold
from ..session import checkpoint_dir
from . import oracle_sql as O
from .jobs import analyze_pages, run_end_to_end
from .queries import _hist_sql, _x16_sql, labelled_docs
from .queries_vectors import _DOC_PAIRS, _FLAT, DUP_T
from .registry import register, table

TREES = 500          # the reference forest size


@register("e1_end_to_end")
def e1_end_to_end(spark, sf):
    out = run_end_to_end(table(spark, sf, "pages"), num_trees=TREES)
    return out["scored"].select("page_id", "url", "word_count", "sentence_count", "flesch_reading_ease",
                                F.array_join("top_keywords", ", ").alias("top_keywords"),
                                "quality_label", "predicted_quality", "split")


def _doc_model(spark, sf):
    s = M.stratified_split(labelled_docs(spark, sf), "quality_label", "doc_id", 0.3, 42)
    return M.train_quality_model(s.filter(F.col("split") == "train"), num_trees=TREES)


@register("e2_analyze_pages")
def e2_analyze_pages(spark, sf):
    return analyze_pages(table(spark, sf, "pages"), table(spark, sf, "documents"),
                         model=_doc_model(spark, sf))


@register("e2_analyze_pages_without_model", f"""
WITH p AS (SELECT * FROM ({_x16_sql(False)}) WHERE body_text <> '' AND word_count > 0),
raw AS (SELECT *, {O.sentence_count('body_text')} AS sentence_count, {O.syllable_count('body_text')} AS syl FROM p),
f AS (SELECT *, {O.flesch('word_count', 'sentence_count', 'syl')} AS readability FROM raw)
SELECT page_id, url, title, word_count, sentence_count, readability, 'Unknown' AS quality_label, word_count < 500 AS is_thin,
       CASE WHEN readability BETWEEN 50 AND 70 THEN 'Optimal' WHEN readability < 30 THEN 'Very Difficult'
            WHEN readability > {L.READ_SIMPLE} THEN 'Too Simple' ELSE 'Could Be Improved' END AS readability_band,
       substring(body_text, 1, 500) AS body_preview
FROM f""")
def e2_analyze_pages_without_model(spark, sf):
    """E2 where no model is saved (label Unknown): its columns but for the similar pages, which j4_* check."""
    out = analyze_pages(table(spark, sf, "pages"), table(spark, sf, "documents"))
    return out.drop("similar_to", "max_similarity", "similarity_band")


@register("e3_analyze_stream")
def e3_analyze_stream(spark, sf):
    from ..streaming.analyze import analyze_stream
    base = f"{checkpoint_dir(spark).rstrip('/')}/e3-{uuid.uuid4().hex}"
    q = analyze_stream(spark, f"{sf.rstrip('/')}/pages*.parquet", table(spark, sf, "documents"),
                       f"{base}/out", checkpoint=f"{base}/ck", model=_doc_model(spark, sf))
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("epoch")


@register("a4_pair_similarity_histogram", f"""
WITH {_DOC_PAIRS}, {_FLAT.replace("flat AS (", "flat0 AS (").replace(
    "SELECT a.id AS i, b.id AS j FROM mem a", "SELECT 1.0::DOUBLE AS sim FROM mem a").replace(
    "SELECT m1.id AS i, m2.id AS j FROM rp", "SELECT rp.sim FROM rp")}
""" + _hist_sql("sim", 20, src="flat0", feature="similarity"))
def a4_pair_similarity_histogram(spark, sf):
    v = SIM.as_vectors(EM.hashed_tfidf(table(spark, sf, "documents")), "doc_id", sparse=("indices", "values"))
    pairs, groups = SIM.duplicate_pairs(v, DUP_T, bins=20)
    w = pairs.select("similarity", F.col("pairs").alias("w")).unionByName(
        groups.select(F.lit(1.0).alias("similarity"),
                      (F.col("copies") * (F.col("copies") - 1) / 2).cast("long").alias("w")))
    return S.histogram(hold(w), "similarity", 20, weight_col="w")  # read for its ends and for its counts
