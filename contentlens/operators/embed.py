"""Text -> vector.  Built-in encoder: hashed TF-IDF, fully native.

bucket(term) = pmod(int(first 8 hex digits of md5(term)), dim)
weight(doc, bucket) = sum over the doc's terms in that bucket of tf * idf,
idf = ln((1 + n) / (1 + df)) + 1 (smooth, no vocabulary cut), then each
document vector is L2-normalised.  Output is sparse:
``indices array<int>`` (ascending) and ``values array<float>``.

Per-bucket sums are taken in DECIMAL(38,18): exact, so the result does not
depend on the order rows reach an aggregate (identical texts always get
bit-identical vectors, which the copy collapse of the pair search relies on).
The per-document squared norm is an exact DECIMAL sum as well.

Where every row has an id of its own (a count says so), terms are counted within their row and never shuffled as
(document, term) rows: the ``KNOWN`` terms of largest df go to the tasks with their weights, and only the other terms of a text
are joined with their df (``_encode_rows``).  Rows that share an id count as one document, in long form (``_encode_tf``).

A pluggable encoder (any per-batch model) can be passed to ``encode_with``;
it runs in ``mapInPandas`` with the model loaded once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .holding import hold
from .stats import attach_scalars

DEFAULT_DIM = 384
KNOWN = 200_000   # terms whose weights every task holds; the driver receives as many
SLICE = 512       # texts a task counts at a time


def term_bucket(term, dim: int = DEFAULT_DIM) -> Column:
    h = F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(dim)).cast("int")


def _terms(text_col: str) -> Column:
    """Every term of the whole text (no prefix cut)."""
    return X.drop_stop_terms(X.tokenize_terms(text_col))


def _tf(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    toks = docs.select(F.col(id_col).alias("doc"), F.explode(_terms(text_col)).alias("term"))
    return toks.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def fit_idf(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            tf: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Corpus statistics: (term, df) for every term, and a one-row (n) frame."""
    tf = tf if tf is not None else _tf(corpus, id_col, text_col)
    # count("tf") (not count(1)) keeps the tf column in the plan, so this
    # branch and the encoder share one term-frequency shuffle (exchange reuse).
    df = tf.groupBy("term").agg(F.count("tf").alias("df"))
    n = corpus.agg(F.count(F.lit(1)).alias("n"))
    return df, n


def _encode_tf(ids: DataFrame, tf: DataFrame, term_df: DataFrame, n: DataFrame, id_col: str,
               dim: int) -> DataFrame:
    # Sort-merge join on term; AQE splits a hot term's partition (skew join)
    # and switches to broadcast at run time when the statistics are small.
    j = attach_scalars(tf.join(term_df, "term", "left"), n)
    idf = F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.coalesce(F.col("df"), F.lit(0)))) + F.lit(1.0)
    w = j.select("doc", term_bucket(F.col("term"), dim).alias("bucket"),
                 (F.col("tf") * idf).cast("decimal(38,18)").alias("w"))
    # One shuffle by document serves both aggregates below: (doc, bucket) and
    # doc are both clustered by doc.  A document is one source row, so a key
    # is bounded by the length of one text.
    wb = w.repartition("doc").groupBy("doc", "bucket").agg(F.sum("w").cast("double").alias("w"))
    per_doc = wb.groupBy("doc").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "w"))).alias("e"),
        F.sum((F.col("w") * F.col("w")).cast("decimal(38,18)")).cast("double").alias("ss"))
    vec = per_doc.select("doc", F.transform("e", lambda x: x["bucket"]).alias("indices"),
                         F.transform("e", lambda x: (x["w"] / F.sqrt("ss")).cast("float")).alias("values"))
    out = ids.select(F.col(id_col).alias("doc")).join(vec, "doc", "left")
    return out.select(
        F.col("doc").alias(id_col),
        F.coalesce("indices", F.array().cast("array<int>")).alias("indices"),
        F.coalesce("values", F.array().cast("array<float>")).alias("values"))


def _own_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether every row of ``docs`` has an id that no other row has."""
    most = docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("c")).agg(
        F.max("c").alias("c"), F.count(F.when(F.col("id").isNull(), 1)).alias("nulls")).first()
    return (most["c"] or 1) == 1 and not most["nulls"]


def _lists(rows: np.ndarray, count: int, values: pa.Array) -> pa.Array:
    """``values``, whose ascending row numbers are ``rows``, as one list for each of ``count`` rows."""
    ends = np.searchsorted(rows, np.arange(count + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _bucket_sums(rows: np.ndarray, buckets: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, sum) in ascending order, for weights sorted by row and bucket; summed in extended precision in their order."""
    if not len(rows):
        return rows, buckets, w
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (buckets[1:] != buckets[:-1])))
    return rows[first], buckets[first], np.add.reduceat(w.astype(np.longdouble), first).astype(np.float64)


def _encode_rows(docs: DataFrame, term_df: DataFrame, n: DataFrame, id_col: str, text_col: str, dim: int) -> DataFrame:
    """``encode`` for rows with ids of their own: one scan counts the terms of each text and sums the known ones by bucket;
    the others are joined with their df and added.  Sums follow the order of df and spelling, so equal texts have equal vectors."""
    total = float(n.first()["n"])
    known = (term_df.orderBy(F.desc("df"), F.asc("term")).limit(KNOWN)
             .select("term", "df", term_bucket(F.col("term"), dim).alias("bucket")).toArrow())
    weight = np.log((1.0 + total) / (1.0 + known["df"].to_numpy())) + 1.0
    shared = docs.sparkSession.sparkContext.broadcast(
        (known["term"].combine_chunks(), weight, known["bucket"].to_numpy().astype(np.int64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf, bucket = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                lists = batch.column(1)
                flat = lists.flatten()
                size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
                row = np.repeat(np.arange(len(size)), size)
                code = np.asarray(pc.fill_null(pc.index_in(flat, terms), -1)).astype(np.int64)
                some = code >= 0
                pair, tf = np.unique(row[some] * len(terms) + code[some], return_counts=True) if some.any() else (np.zeros(0, int),) * 2
                r, c = np.divmod(pair, max(1, len(terms)))
                order = np.lexsort((c, bucket[c], r))
                r, c, tf = r[order], c[order], tf[order]
                r, b, w = _bucket_sums(r, bucket[c], tf * idf[c])
                other = flat.filter(pa.array(~some)).dictionary_encode()
                pair, tf = np.unique(row[~some] * max(1, len(other.dictionary)) + np.asarray(other.indices), return_counts=True)
                ro, co = np.divmod(pair, max(1, len(other.dictionary)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), _lists(r, len(size), pa.array(b.astype(np.int32))), _lists(r, len(size), pa.array(w)),
                    _lists(ro, len(size), other.dictionary.take(pa.array(co))), _lists(ro, len(size), pa.array(tf.astype(np.int64)))],
                    ["doc", "indices", "sums", "others", "tfs"])

    kind = docs.schema[id_col].dataType.simpleString()
    counted = hold(docs.select(F.col(id_col).alias("doc"), _terms(text_col).alias("terms")).mapInArrow(
        count, f"doc {kind}, indices array<int>, sums array<double>, others array<string>, tfs array<bigint>"))
    rest = counted.select("doc", F.inline(F.arrays_zip(F.col("others").alias("term"), F.col("tfs").alias("tf"))))
    rest = rest.join(term_df, "term", "left").select("doc", F.struct(
        term_bucket(F.col("term"), dim).alias("bucket"), "term", "tf", F.coalesce("df", F.lit(0)).cast("long").alias("df")).alias("t"))
    # one list a text, bounded by its own words
    rest = rest.groupBy("doc").agg(F.sort_array(F.collect_list("t")).alias("ts")).select(
        "doc", F.col("ts.bucket").alias("more"), F.col("ts.tf").alias("tf"), F.col("ts.df").alias("df"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)

                def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
                    lists = batch.column(batch.schema.get_field_index(name))
                    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
                    return np.repeat(np.arange(len(size)), size), np.asarray(lists.flatten())

                (r, b), (_, w) = flat("indices"), flat("sums")
                (ro, bo), (_, tf), (_, df) = flat("more"), flat("tf"), flat("df")
                more = _bucket_sums(ro, bo, tf * (np.log((1.0 + total) / (1.0 + df)) + 1.0))
                r, b, w = (np.append(x, y) for x, y in zip((r, b, w), more))
                order = np.lexsort((b, r))  # stable: the known terms' sum first
                r, b, w = _bucket_sums(r[order], b[order], w[order])
                norm = np.zeros(batch.num_rows, np.longdouble)
                np.add.at(norm, r, (w * w).astype(np.longdouble))
                values = (w / np.sqrt(norm.astype(np.float64))[r]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(r, batch.num_rows, pa.array(b.astype(np.int32))),
                                                  _lists(r, batch.num_rows, pa.array(values))], [id_col, "indices", "values"])

    both = counted.select("doc", "indices", "sums").join(rest, "doc", "left")
    return both.mapInArrow(finish, f"{id_col} {kind}, indices array<int>, values array<float>")


def encode(docs: DataFrame, term_df: DataFrame, n: DataFrame, id_col: str = "doc_id",
           text_col: str = "text", dim: int = DEFAULT_DIM) -> DataFrame:
    """(id, indices, values) for every input row; empty texts get empty arrays.

    ``term_df``/``n`` come from ``fit_idf``/``fit`` on the corpus (the docs
    themselves or another table); terms the corpus never saw get df = 0.
    """
    if _own_ids(docs, id_col):
        return _encode_rows(docs, term_df, n, id_col, text_col, dim)
    return _encode_tf(docs, _tf(docs, id_col, text_col), term_df, n, id_col, dim)


def fit(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        dim: int = DEFAULT_DIM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit on a corpus and encode it: (vectors, term_df, n).

    The document frequencies are kept (``persist(MEMORY_AND_DISK)``, rebuilt from lineage if an executor is
    lost), for the corpus vectors and any later query encoding read them.  Where rows share an id, the
    term frequencies are kept as well.
    """
    n = corpus.agg(F.count(F.lit(1)).alias("n"))
    if _own_ids(corpus, id_col):
        terms = corpus.select(F.explode(F.array_distinct(_terms(text_col))).alias("term"))
        term_df = hold(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        return _encode_rows(corpus, term_df, n, id_col, text_col, dim), term_df, n
    tf = hold(_tf(corpus, id_col, text_col))
    term_df, n = fit_idf(corpus, id_col, text_col, tf=tf)
    return _encode_tf(corpus, tf, term_df, n, id_col, dim), term_df, n


def hashed_tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 dim: int = DEFAULT_DIM) -> DataFrame:
    """T14 fitted and applied on the same table."""
    return fit(docs, id_col, text_col, dim)[0]


def to_dense(indices, values, dim: int = DEFAULT_DIM) -> Column:
    """Sparse (indices, values) -> dense array<float> of length ``dim``."""
    m = F.map_from_arrays(F.col(indices) if isinstance(indices, str) else indices,
                          F.col(values) if isinstance(values, str) else values)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                       lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0).cast("float")))


def long_form(vectors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, bucket, weight) rows of a sparse vector table."""
    return vectors.select(id_col, F.inline(F.arrays_zip(
        F.col("indices").alias("bucket"), F.col("values").alias("weight"))))


def encode_with(docs: DataFrame, model_factory: Callable, id_col: str = "doc_id",
                text_col: str = "text", dim: int = DEFAULT_DIM, batch_size: int = 32) -> DataFrame:
    """Pluggable encoder: ``model_factory()`` returns an object with
    ``encode(list[str], batch_size=...) -> array (n, dim)``; loaded once per worker."""
    schema = f"{id_col} long, embedding array<float>"

    def run(batches):
        import pandas as pd
        model = model_factory()
        for pdf in batches:
            texts = pdf[text_col].fillna("").astype(str).tolist()
            emb = np.asarray(model.encode(texts, batch_size=batch_size), dtype="float32")
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), "embedding": list(emb)})

    return docs.select(id_col, text_col).mapInPandas(run, schema)
