"""TF-IDF family (T1-T4, T13) in long format: (doc, term, value) rows.

Plan shape (no densified matrix, nothing collected):
  1. tokens are produced per row (native regex + ``InSet`` stopword filter)
     and exploded;
  2. ``groupBy(doc, term).count()`` — one document is one row, so the
     map-side partial aggregate already holds its exact term counts;
  3. corpus statistics ``groupBy(term)`` (partial + final aggregate; a hot
     term costs one row per map task, not one per occurrence);
  4. the vocabulary is cut to ``max_features`` rows (``TakeOrderedAndProject``),
     so its broadcast is bounded by a parameter, not by the data;
  5. weights, L2 norm and per-document ranks use one window partitioned by
     document.

Where every row has an id of its own and the vocabulary is cut, steps 2 and 3 are one
aggregation by term (``_counted``): a text's terms are sorted within its row, so their first places
give the df, and (doc, term) rows exist for the kept vocabulary only.

Smooth idf: ``ln((1 + n) / (1 + df)) + 1`` (MLlib's ``IDF`` omits the
``+1``, so it is not used).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .holding import hold
from .stats import attach_scalars


def term_frequencies(docs: DataFrame, id_col: str, terms: Column, keep: bool = True) -> DataFrame:
    """(id, term, tf) for every term occurrence count > 0.

    The table feeds both the corpus statistics and the weights; ``keep``
    persists it (MEMORY_AND_DISK, rebuilt from lineage if lost) so the texts
    are tokenized once.
    """
    toks = docs.select(F.col(id_col).alias("doc"), F.explode(terms).alias("term"))
    tf = toks.groupBy("doc", "term").agg(F.count(F.lit(1)).cast("long").alias("tf"))
    return hold(tf) if keep else tf


def _counted(docs: DataFrame, id_col: str, terms: Column, bounded: bool) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(term, cnt, df) of all terms, and a function from a vocabulary to the (doc, term, tf) rows of its terms."""
    from .embed import _own_ids
    if not (bounded and _own_ids(docs, id_col)):
        tf = term_frequencies(docs, id_col, terms)
        return term_stats(tf), lambda vocab: tf
    row = docs.select(F.col(id_col).alias("doc"), terms.alias("terms"))
    first = F.transform("ts", lambda t, i: F.struct(t.alias("term"), F.when(F.get("ts", i - 1) == t, 0).otherwise(1).alias("new")))
    stats = (row.select(F.sort_array("terms").alias("ts")).select(F.inline(first))
             .groupBy("term").agg(F.count(F.lit(1)).alias("cnt"), F.sum("new").alias("df")))

    def of(vocab: DataFrame) -> DataFrame:
        kept = row.select("doc", F.explode("terms").alias("term")).join(F.broadcast(vocab.select("term")), "term")
        return kept.groupBy("doc", "term").agg(F.count(F.lit(1)).cast("long").alias("tf"))

    return stats, of


def term_stats(tf: DataFrame) -> DataFrame:
    """(term, cnt, df) of (doc, term, tf) rows."""
    return tf.groupBy("term").agg(F.sum("tf").alias("cnt"), F.count(F.lit(1)).alias("df"))


def vocabulary(stats: DataFrame, n_docs: DataFrame, max_features: int | None,
               min_df: int | float = 1, max_df: int | float = 1.0) -> DataFrame:
    """Terms kept by the vectorizer: df filters first, then the ``max_features``
    most frequent terms over the corpus (ties by term).  Adds ``idf`` to ``stats`` (term, cnt, df).

    ``n_docs`` is a one-row DataFrame with column ``n``.
    """
    stats = attach_scalars(stats, n_docs)
    lo = F.lit(float(min_df)) * F.col("n") if isinstance(min_df, float) else F.lit(min_df)
    hi = F.lit(float(max_df)) * F.col("n") if isinstance(max_df, float) else F.lit(max_df)
    stats = stats.filter((F.col("df") >= lo) & (F.col("df") <= hi))
    if max_features is not None:
        stats = stats.orderBy(F.desc("cnt"), F.asc("term")).limit(max_features)
    idf = F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return stats.select("term", "cnt", "df", idf.alias("idf"))


def tfidf_weights(tf: DataFrame, vocab: DataFrame, bounded_vocab: bool = True) -> DataFrame:
    """(doc, term, weight): tf * idf, L2-normalised over each document's vocabulary terms."""
    v = F.broadcast(vocab.select("term", "idf")) if bounded_vocab else vocab.select("term", "idf")
    w = tf.join(v, "term").select("doc", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return w.select("doc", "term", (F.col("w") / norm).alias("weight"))


def _keyword_docs(docs: DataFrame, id_col: str, text_col: str, stopwords=None):
    """The documents, the term expression, and the number of valid documents
    (non-empty after X6 + X7).

    No filter: a document with no kept word yields no terms anyway, and a
    filter here would be pushed below a narrow scan's round-robin spread
    (Catalyst pushes predicates through ``Repartition``) and run in the scan
    task.  The count is a conditional aggregate instead, evaluated after it.
    """
    words = list(X.ENGLISH_STOPWORDS if stopwords is None else stopwords)
    toks = F.split(X.preprocess_text(text_col), " ")
    # short-circuits at the first kept word: cheap, unlike rebuilding the text
    has_word = F.exists(toks, lambda w: (w != "") & ~w.isin(words)) if words else \
        F.exists(toks, lambda w: w != "")
    terms = X.keyword_terms(text_col, stopwords)
    n = docs.agg(F.count(F.when(has_word, 1)).alias("n"))
    return docs, terms, n


def keyword_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   max_features: int = 100, stopwords=None) -> DataFrame:
    """T2 as used by T1: (doc, term, weight) over the ``max_features`` vocabulary.

    ``stopwords``: None = the English list; ``[]`` = keep every word.
    """
    docs, terms, n = _keyword_docs(docs, id_col, text_col, stopwords)
    stats, tf_of = _counted(docs, id_col, terms, max_features is not None)
    vocab = hold(vocabulary(stats, n, max_features))
    # broadcast only a vocabulary cut to max_features rows
    return tfidf_weights(tf_of(vocab), vocab, bounded_vocab=max_features is not None)


def top_keywords(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 top_n: int = 5, max_features: int = 100, as_string: bool = True,
                 stopwords=None) -> DataFrame:
    """Per document, its ``top_n`` terms by TF-IDF weight (score > 0).

    Every input row is returned; documents with no vocabulary term get ''
    (or an empty array with ``as_string=False``).  Weights are rounded to 6
    places before ranking so float noise cannot reorder ties (ties by term).
    """
    m = keyword_matrix(docs, id_col, text_col, max_features, stopwords)
    rw = F.round("weight", 6)
    w = Window.partitionBy("doc").orderBy(rw.desc(), F.col("term").asc())
    ranked = (m.filter(F.col("weight") > 0).withColumn("rk", F.row_number().over(w))
              .filter(F.col("rk") <= top_n))
    per_doc = ranked.groupBy("doc").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rk", "term"))), lambda s: s["term"]).alias("kw"))
    out = docs.select(id_col).join(per_doc, docs[id_col] == per_doc["doc"], "left")
    kw = F.coalesce(F.col("kw"), F.array().cast("array<string>"))
    return out.select(id_col, (F.array_join(kw, ", ") if as_string else kw).alias("top_keywords"))


def corpus_keywords(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    top: int = 20, max_features: int = 50, min_df: int | float = 2,
                    max_df: int | float = 0.8, min_chars: int = 50) -> DataFrame:
    """Mean TF-IDF (1-2-grams) over all documents longer than ``min_chars``.

    Zeros count in the mean, so the sum is divided by the number of documents.
    """
    sample = docs.filter(F.length(X.text_or_empty(text_col)) > min_chars)
    toks = sample.select(id_col, X.drop_stop_terms(X.tokenize_terms(text_col)).alias("_t"))
    n = sample.agg(F.count(F.lit(1)).alias("n"))
    stats, tf_of = _counted(toks, id_col, X.ngrams_1_2("_t"), max_features is not None)
    vocab = hold(vocabulary(stats, n, max_features, min_df, max_df))
    weights = tfidf_weights(tf_of(vocab), vocab, bounded_vocab=max_features is not None)
    score = (weights.groupBy("term").agg(F.sum("weight").alias("s"))
             .transform(lambda d: attach_scalars(d, n))
             .select("term", F.round(F.col("s") / F.col("n"), 6).alias("score")))
    return score.orderBy(F.desc("score"), F.asc("term")).limit(top)


def count_vectorize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    max_features: int = 1000, min_df: int | float = 2, max_df: int | float = 0.8,
                    min_chars: int = 50) -> tuple[DataFrame, DataFrame]:
    """T4: (doc, term, count) over the fitted vocabulary, and the vocabulary itself
    (term, cnt, df, idf) — at most ``max_features`` rows."""
    sample = docs.filter(F.length(X.text_or_empty(text_col)) > min_chars)
    n = sample.agg(F.count(F.lit(1)).alias("n"))
    stats, tf_of = _counted(sample, id_col, X.drop_stop_terms(X.tokenize_terms(text_col)), max_features is not None)
    vocab = hold(vocabulary(stats, n, max_features, min_df, max_df))
    terms = vocab.select("term")
    terms = F.broadcast(terms) if max_features is not None else terms
    counts = tf_of(vocab).join(terms, "term").select("doc", "term", F.col("tf").alias("count"))
    return counts, vocab


def term_frequency(docs: DataFrame, text_col: str = "text", top: int = 100) -> DataFrame:
    """The ``top`` most frequent words over the pooled text; weight = n / max n."""
    toks = docs.select(F.explode(X.drop_stop_terms(X.tokenize_terms(text_col))).alias("term"))
    counts = toks.groupBy("term").agg(F.count(F.lit(1)).cast("long").alias("n"))
    topn = counts.orderBy(F.desc("n"), F.asc("term")).limit(top)
    mx = topn.agg(F.max("n").alias("mx"))
    return attach_scalars(topn, mx).select(
        "term", "n", F.round(F.col("n") / F.col("mx"), 6).alias("weight"))
