"""Terms counted within their row against (doc, term) rows."""

import pytest
from pyspark.sql import functions as F

from contentlens.functions import text as X
from contentlens.operators import tfidf as T

TEXTS = ["alpha beta beta gamma", "gamma beta alpha beta", "", None, "the of", "zeta alpha zeta zeta", "beta beta"]


def _both(spark, ids):
    docs = spark.createDataFrame(list(zip(ids, TEXTS)), "doc_id long, text string").repartition(3)
    terms = X.keyword_terms("text")
    tf = T.term_frequencies(docs, "doc_id", terms)
    return docs, terms, tf, *T._counted(docs, "doc_id", terms, True)


@pytest.mark.parametrize("ids", [list(range(7)), [0, 0, 1, 2, None, None, 3]])
def test_counts_are_those_of_the_long_form(spark, ids):
    _, _, tf, stats, tf_of = _both(spark, ids)
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    assert rows(stats, "term", "cnt", "df") == rows(T.term_stats(tf), "term", "cnt", "df")
    vocab = stats.filter(F.col("term").isin("beta", "zeta"))
    kept = rows(tf_of(vocab).join(vocab.select("term"), "term"), "doc", "term", "tf")
    assert kept == rows(tf.filter(F.col("term").isin("beta", "zeta")), "doc", "term", "tf")


def test_documents_are_no_key_of_the_corpus_counts(spark):
    *_, stats, _ = _both(spark, list(range(7)))
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Aggregate [doc" not in plan
