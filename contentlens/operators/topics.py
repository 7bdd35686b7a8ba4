"""Topic model (MLlib LDA) over the T4 document-term counts.

The vocabulary is the T4 vocabulary (at most ``max_features`` terms, a model
parameter), so bringing it to the driver to build the CountVectorizerModel is
bounded by a parameter, not by the data.
"""

from __future__ import annotations

from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import tfidf as T
from .holding import hold


def doc_term_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     max_features: int = 1000, min_df=2, max_df=0.8, min_chars: int = 50):
    """(id, features) sparse count vectors plus the ordered vocabulary list."""
    if max_features is None:
        raise ValueError("max_features must be set: the vocabulary comes to the driver")
    _, vocab = T.count_vectorize(docs, id_col, text_col, max_features, min_df, max_df, min_chars)
    terms = [r["term"] for r in vocab.orderBy(F.desc("cnt"), F.asc("term")).select("term").collect()]
    sample = docs.filter(F.length(X.text_or_empty(text_col)) > min_chars)
    toks = sample.select(id_col, X.drop_stop_terms(X.tokenize_terms(text_col)).alias("tokens"))
    cv = CountVectorizerModel.from_vocabulary(terms, inputCol="tokens", outputCol="features")
    return hold(cv.transform(toks).select(id_col, "features")), terms  # every LDA pass reads it


def fit_topics(vectors: DataFrame, k: int = 5, max_iter: int = 20, seed: int = 42) -> LDAModel:
    """T5: online LDA (the estimator family of the reference's topic model)."""
    lda = LDA(k=k, maxIter=max_iter, seed=seed, optimizer="online", subsamplingRate=1.0,
              featuresCol="features", topicDistributionCol="topics")
    return lda.fit(vectors)


def topic_terms(model: LDAModel, terms: list[str], n: int = 10) -> DataFrame:
    """(topic, rank, term, weight) — top ``n`` words per topic."""
    d = model.describeTopics(n)
    spark = d.sparkSession
    vocab = spark.createDataFrame(list(enumerate(terms)), "term_index int, term string")
    ex = d.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "tw"))
    ex = ex.select("topic", (F.col("rank") + 1).alias("rank"), F.col("tw.termIndices").alias("term_index"),
                   F.col("tw.termWeights").alias("weight"))
    return ex.join(F.broadcast(vocab), "term_index").select("topic", "rank", "term", "weight")


def document_topics(model: LDAModel, vectors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: its topic weights (summing to 1) and dominant topic."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(vectors).select(id_col, vector_to_array(F.col("topics")).alias("_w"))
    arr = F.col("_w")
    return out.select(id_col, (F.array_position(arr, F.array_max(arr)) - 1).cast("int").alias("dominant_topic"),
                      arr.alias("topic_weights"))

