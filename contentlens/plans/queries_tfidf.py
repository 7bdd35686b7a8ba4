"""Registered TF-IDF family queries (T1-T4, T13) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tfidf as T
from . import oracle_sql as O
from .registry import register, table

_KW_DOCS = f"""
kd AS (SELECT doc_id, kept FROM (
        SELECT doc_id, array_to_string(list_filter(string_split({O.clean_ws("lower(coalesce(text, ''))")}, ' '),
               lambda w: w <> '' AND NOT list_contains({O.STOP_LIST}, w)), ' ') AS kept FROM documents)
       WHERE kept <> ''),
nd AS (SELECT count(*) AS n FROM kd),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (
        SELECT doc_id, unnest(list_filter(regexp_extract_all(kept, {O.q(r"[\p{L}\p{N}_]{2,}")}),
               lambda w: NOT list_contains({O.STOP_LIST}, w))) AS term FROM kd) GROUP BY 1, 2),
st AS (SELECT term, sum(tf) AS cnt, count(*) AS df FROM tf GROUP BY 1),
vocab AS (SELECT term, df, ln((1 + n)::DOUBLE / (1 + df)::DOUBLE) + 1 AS idf
          FROM st, nd ORDER BY cnt DESC, term ASC LIMIT 100),
w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN vocab USING (term)),
nw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)
"""


@register("t2_tfidf", f"""
WITH {_KW_DOCS}
SELECT doc_id AS doc, term, round(weight, 6) AS weight FROM nw""")
def t2_tfidf(spark, sf):
    m = T.keyword_matrix(table(spark, sf, "documents"))
    return m.select("doc", "term", F.round("weight", 6).alias("weight"))


@register("t1_top_keywords", f"""
WITH {_KW_DOCS},
rk AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, term) AS r
       FROM nw WHERE weight > 0)
SELECT d.doc_id, coalesce(string_agg(rk.term, ', ' ORDER BY rk.r), '') AS top_keywords
FROM documents d LEFT JOIN rk ON rk.doc_id = d.doc_id AND rk.r <= 5
GROUP BY d.doc_id""")
def t1_top_keywords(spark, sf):
    return T.top_keywords(table(spark, sf, "documents"))


def _sample_tf_sql(ngrams: bool) -> str:
    terms = O.plain_terms("text")
    if ngrams:
        g = ("CASE WHEN len(t) >= 2 THEN list_concat(t, list_transform(range(1, len(t)), "
             "lambda i: t[i] || ' ' || t[i + 1])) ELSE t END")
    else:
        g = "t"
    return f"""
sd AS (SELECT doc_id, {terms} AS t FROM documents WHERE length(coalesce(text, '')) > 50),
nd AS (SELECT count(*) AS n FROM sd),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({g}) AS term FROM sd) GROUP BY 1, 2),
st AS (SELECT term, sum(tf) AS cnt, count(*) AS df FROM tf GROUP BY 1)"""


@register("t3_corpus_keywords", f"""
WITH {_sample_tf_sql(True)},
vocab AS (SELECT term, ln((1 + n)::DOUBLE / (1 + df)::DOUBLE) + 1 AS idf FROM st, nd
          WHERE df >= 2 AND df <= 0.8::DOUBLE * n ORDER BY cnt DESC, term ASC LIMIT 50),
w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN vocab USING (term)),
nw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)
SELECT term, round(sum(weight) / any_value(n), 6) AS score FROM nw, nd GROUP BY term
ORDER BY score DESC, term LIMIT 20""")
def t3_corpus_keywords(spark, sf):
    return T.corpus_keywords(table(spark, sf, "documents"))


@register("t4_count_vectorize", f"""
WITH {_sample_tf_sql(False)},
vocab AS (SELECT term FROM st, nd WHERE df >= 2 AND df <= 0.8::DOUBLE * n
          ORDER BY cnt DESC, term ASC LIMIT 1000)
SELECT doc_id AS doc, term, tf AS count FROM tf JOIN vocab USING (term)""")
def t4_count_vectorize(spark, sf):
    counts, _ = T.count_vectorize(table(spark, sf, "documents"))
    return counts


@register("t13_term_frequency", f"""
WITH c AS (SELECT term, count(*)::BIGINT AS n FROM (
             SELECT unnest({O.plain_terms("coalesce(text, '')")}) AS term FROM documents) GROUP BY 1
           ORDER BY n DESC, term LIMIT 100)
SELECT term, n, round(n / (SELECT max(n) FROM c)::DOUBLE, 6) AS weight FROM c""")
def t13_term_frequency(spark, sf):
    return T.term_frequency(table(spark, sf, "documents"))


from . import queries_vectors  # noqa: E402,F401
