"""Registered queries, one per operator of the inventory (text, labels, statistics).

Other families register from sibling modules imported at the bottom.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import labels as L
from ..functions import text as X
from ..operators import extract as E
from ..operators import stats as S
from ..operators.holding import hold
from . import oracle_sql as O
from .registry import register, table

FEATURE_COLS = ["word_count", "sentence_count", "flesch_reading_ease"]


def doc_features(spark, sf):
    return E.extract_features(table(spark, sf, "documents"), "text", keep=("doc_id",))


def labelled_docs(spark, sf):
    f = doc_features(spark, sf)
    return f.withColumn("quality_label", L.quality_label("word_count", "flesch_reading_ease"))


# ----------------------------------------------------------------- sources
@register("s1_read_pages", """
SELECT page_id, url, length(coalesce(html, ''))::BIGINT AS html_chars FROM pages""")
def s1_read_pages(spark, sf):
    from ..sources.readers import read_pages
    p = read_pages(spark, f"{sf}/pages.parquet", fmt="parquet", html_col="html")
    return p.select("page_id", "url", F.length(F.coalesce("html", F.lit(""))).cast("long").alias("html_chars"))


@register("s1_read_pages_split_csv", """
SELECT url, coalesce(html, '') AS html, count(*)::BIGINT AS n FROM pages GROUP BY 1, 2""")
def s1_read_pages_split_csv(spark, sf):
    """The pages written as CSV to the shared folder and cut into records by byte ranges."""
    import uuid

    from ..session import checkpoint_dir
    from ..sources.readers import read_pages, write_table
    path = f"{checkpoint_dir(spark).rstrip('/')}/contentlens-pages-{uuid.uuid4().hex}"
    write_table(table(spark, sf, "pages").select("url", "html"), path, fmt="csv")
    read = read_pages(spark, path, html_col="html", split_records=True)
    return read.groupBy("url", F.coalesce("html", F.lit("")).alias("html")).agg(F.count(F.lit(1)).alias("n"))


@register("s2_read_content", """
SELECT doc_id, 'doc:' || doc_id::VARCHAR AS url, length(coalesce(text, ''))::BIGINT AS body_chars
FROM documents""")
def s2_read_content(spark, sf):
    c = E.documents_as_content(table(spark, sf, "documents"))
    return c.select("doc_id", "url", F.length("body_text").cast("long").alias("body_chars"))


@register("s3_read_features", """
SELECT vec_id, len(embedding)::BIGINT AS dims, label FROM embeddings WHERE embedding IS NOT NULL""")
def s3_read_features(spark, sf):
    from ..sources.readers import read_features
    f = read_features(spark, f"{sf}/embeddings.parquet").filter(F.col("embedding").isNotNull())
    return f.select("vec_id", F.size("embedding").cast("long").alias("dims"), "label")


# ------------------------------------------------------------ text scalars
@register("x4_clean_whitespace", f"""
SELECT doc_id, {O.clean_ws("coalesce(text, '')")} AS cleaned FROM documents""")
def x4_clean_whitespace(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_whitespace(X.text_or_empty("text")).alias("cleaned"))


@register("x5_word_count", f"""
SELECT doc_id, {O.word_count("coalesce(text, '')")} AS word_count FROM documents""")
def x5_word_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.word_count("text").alias("word_count"))


@register("x6_preprocess_text", f"""
SELECT doc_id, {O.clean_ws("lower(coalesce(text, ''))")} AS processed FROM documents""")
def x6_preprocess_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.preprocess_text("text").alias("processed"))


@register("x7_remove_stopwords", f"""
SELECT doc_id, array_to_string(list_filter(string_split({O.clean_ws("lower(coalesce(text, ''))")}, ' '),
       lambda w: w <> '' AND NOT list_contains({O.STOP_LIST}, w)), ' ') AS without_stopwords
FROM documents""")
def x7_remove_stopwords(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.remove_stopwords(X.preprocess_text("text")).alias("without_stopwords"))


@register("x8_sentence_count", f"""
SELECT doc_id, {O.sentence_count("coalesce(text, '')")} AS sentence_count FROM documents""")
def x8_sentence_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.sentence_count("text").alias("sentence_count"))


@register("x10_syllable_count", f"""
SELECT doc_id, {O.syllable_count("coalesce(text, '')")} AS syllables FROM documents""")
def x10_syllable_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.syllable_count("text").alias("syllables"))


@register("x11_text_features", f"""
WITH {O.DOC_FEATURES}
SELECT doc_id, word_count, sentence_count, flesch_reading_ease FROM feat""")
def x11_text_features(spark, sf):
    return doc_features(spark, sf)


@register("x14_truncate_text", """
SELECT doc_id, substring(coalesce(text, ''), 1, 5000) AS text_5000,
       substring(coalesce(text, ''), 1, 1000) AS text_1000 FROM documents""")
def x14_truncate_text(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.truncate_text("text", 5000).alias("text_5000"),
                    X.truncate_text("text", 1000).alias("text_1000"))


@register("x17_tokenize_terms", f"""
SELECT doc_id, len(toks)::BIGINT AS n_terms, array_to_string(toks, ' ') AS terms
FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {O.q(X.TERM)}) AS toks FROM documents)""")
def x17_tokenize_terms(spark, sf):
    t = X.tokenize_terms("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.size(t).cast("long").alias("n_terms"), F.array_join(t, " ").alias("terms"))


@register("x18_ngrams", f"""
SELECT doc_id, len(g)::BIGINT AS n_ngrams, array_to_string(g, '|') AS ngrams
FROM (SELECT doc_id,
        CASE WHEN len(t) >= 2
             THEN list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))
             ELSE t END AS g
      FROM (SELECT doc_id, {O.plain_terms("coalesce(text, '')")} AS t FROM documents))""")
def x18_ngrams(spark, sf):
    toks = table(spark, sf, "documents").select(
        "doc_id", X.drop_stop_terms(X.tokenize_terms("text")).alias("toks"))
    g = toks.select("doc_id", X.ngrams_1_2("toks").alias("g"))
    return g.select("doc_id", F.size("g").cast("long").alias("n_ngrams"), F.array_join("g", "|").alias("ngrams"))


# ------------------------------------------------------------------- html
@register("x1_extract_title", f"""
SELECT page_id, {O.title("coalesce(html, '')")} AS title FROM pages""")
def x1_extract_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.extract_title("html").alias("title"))


@register("x3_fallback_body", f"""
SELECT page_id, len(ps)::BIGINT AS n_paragraphs, {O.clean_ws("array_to_string(ps, ' ')")} AS body_text
FROM (SELECT page_id, {O.paragraphs("coalesce(html, '')")} AS ps FROM pages)""")
def x3_fallback_body(spark, sf):
    ps = H.fallback_paragraphs("html")
    return table(spark, sf, "pages").select(
        "page_id", F.size(ps).cast("long").alias("n_paragraphs"),
        X.clean_whitespace(F.array_join(ps, " ")).alias("body_text"))


# The article element made a container by its class; the twin takes the paragraphs inside it.
_CONTAINED = "regexp_extract(regexp_replace(coalesce(html, ''), " + O.q(H.INVISIBLE) + ", '', 'g'), '(?is)<article>(.*?)</article>', 1)"


@register("x2_container_body", f"""
SELECT page_id, {O.body(_CONTAINED)} AS body_text FROM pages""")
def x2_container_body(spark, sf):
    contained = F.replace(F.col("html"), F.lit("<article>"), F.lit('<article class="main-content">'))
    return table(spark, sf, "pages").select("page_id", H.dom_body(contained).alias("body_text"))


@register("x15_html_unescape", f"""
SELECT page_id, {O.decode(f"regexp_replace(regexp_replace(coalesce(html, ''), {O.q(H.INVISIBLE)}, '', 'g'), {O.q(H.TAG)}, '', 'g')")} AS visible_text
FROM pages""")
def x15_html_unescape(spark, sf):
    vis = F.regexp_replace(H.strip_invisible("html"), H.TAG, "")
    return table(spark, sf, "pages").select("page_id", H.decode_entities(vis).alias("visible_text"))


def _x16_sql(compat: bool) -> str:
    b = O.body("coalesce(html, '')", compat)
    return f"""
SELECT page_id, url, title, body_text, {O.word_count('body_text')} AS word_count
FROM (SELECT page_id, url, {O.title("coalesce(html, '')")} AS title, {b} AS body_text FROM pages)"""


@register("x16_parse_pages", _x16_sql(False))
def x16_parse_pages(spark, sf):
    return E.parse_pages(table(spark, sf, "pages"))


@register("x16_parse_pages_compat", _x16_sql(True))
def x16_parse_pages_compat(spark, sf):
    return E.parse_pages(table(spark, sf, "pages"), compat=True)


# ----------------------------------------------------------------- labels
@register("p1_select_features", f"""
WITH {O.DOC_FEATURES}
SELECT 'doc:' || doc_id::VARCHAR AS url, word_count, sentence_count, flesch_reading_ease FROM feat""")
def p1_select_features(spark, sf):
    f = E.extract_features(E.documents_as_content(table(spark, sf, "documents")), "body_text",
                           keep=("url",))
    return f.select("url", *FEATURE_COLS)


@register("p2_quality_label", f"""
WITH {O.DOC_FEATURES}
SELECT doc_id, word_count, flesch_reading_ease,
       {O.quality_label('word_count', 'flesch_reading_ease')} AS quality_label FROM feat""")
def p2_quality_label(spark, sf):
    return labelled_docs(spark, sf).select("doc_id", "word_count", "flesch_reading_ease", "quality_label")


@register("p3_baseline_label", f"""
WITH {O.DOC_FEATURES}
SELECT doc_id, {O.baseline_label('word_count')} AS baseline_label FROM feat""")
def p3_baseline_label(spark, sf):
    return doc_features(spark, sf).select("doc_id", L.baseline_label("word_count").alias("baseline_label"))


@register("p4_thin_content", f"""
WITH {O.DOC_FEATURES}
SELECT doc_id, word_count, true AS is_thin FROM feat WHERE word_count < 500""")
def p4_thin_content(spark, sf):
    f = doc_features(spark, sf).select("doc_id", "word_count", L.is_thin("word_count").alias("is_thin"))
    return f.filter("is_thin")


@register("p5_readability_band", f"""
WITH {O.DOC_FEATURES}
SELECT doc_id,
  CASE WHEN flesch_reading_ease BETWEEN 50 AND 70 THEN 'Optimal'
       WHEN flesch_reading_ease < 30 THEN 'Very Difficult'
       WHEN flesch_reading_ease > 90 THEN 'Too Simple'
       ELSE 'Could Be Improved' END AS readability_band,
  CASE WHEN flesch_reading_ease BETWEEN 50 AND 70 THEN 'Good' ELSE 'Needs Work' END AS readability_flag
FROM feat""")
def p5_readability_band(spark, sf):
    return doc_features(spark, sf).select(
        "doc_id", L.readability_band("flesch_reading_ease").alias("readability_band"),
        L.readability_flag("flesch_reading_ease").alias("readability_flag"))


@register("p8_min_length_filter", """
SELECT doc_id, length(text)::BIGINT AS n_chars, length(text) > 50 AS for_topics,
       length(text) > 10 AS for_sentiment
FROM documents WHERE length(coalesce(text, '')) > 10""")
def p8_min_length_filter(spark, sf):
    d = table(spark, sf, "documents")
    n = F.length(X.text_or_empty("text"))
    return d.filter(n > 10).select("doc_id", n.cast("long").alias("n_chars"),
                                   (n > 50).alias("for_topics"), (n > 10).alias("for_sentiment"))


@register("p11_body_preview", """
SELECT doc_id, substring(coalesce(text, ''), 1, 500) AS body_preview FROM documents""")
def p11_body_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.body_preview("text").alias("body_preview"))


@register("p13_thin_vs_normal", f"""
WITH {O.DOC_FEATURES}
SELECT 'Thin (<500)' AS segment, count(*) FILTER (WHERE word_count < 500) AS n FROM feat
UNION ALL
SELECT 'Normal (>=500)' AS segment, count(*) FILTER (WHERE word_count >= 500) AS n FROM feat""")
def p13_thin_vs_normal(spark, sf):
    return S.thin_vs_normal(doc_features(spark, sf))


@register("p14_by_quality_points", f"""
WITH {O.DOC_FEATURES}
SELECT doc_id, word_count, flesch_reading_ease FROM feat
WHERE {O.quality_label('word_count', 'flesch_reading_ease')} = 'High'""")
def p14_by_quality_points(spark, sf):
    return (labelled_docs(spark, sf).filter(F.col("quality_label") == "High")
            .select("doc_id", "word_count", "flesch_reading_ease"))


@register("p14_by_predicted_quality")
def p14_by_predicted_quality(spark, sf):
    """P14 on the predicted class (the twin above checks the rule label; a model fit has no SQL form)."""
    from ..operators import model as M
    from .queries_jobs import _doc_model
    scored = M.predict_quality(_doc_model(spark, sf), labelled_docs(spark, sf))
    return scored.select("doc_id", "predicted_quality", "word_count", "flesch_reading_ease")


@register("p9_has_content", f"""
SELECT page_id, url, word_count FROM ({_x16_sql(False)}) WHERE body_text <> '' AND word_count > 0""")
def p9_has_content(spark, sf):
    p = E.parse_pages(table(spark, sf, "pages"))
    return p.filter((F.col("body_text") != "") & (F.col("word_count") > 0)).select("page_id", "url", "word_count")


@register("p10_valid_url", """
SELECT page_id, url, coalesce(starts_with(url, 'http://') OR starts_with(url, 'https://'), false) AS is_valid
FROM pages""")
def p10_valid_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", L.valid_url("url").alias("is_valid"))


# -------------------------------------------------------------- statistics
@register("a1_label_distribution", f"""
WITH {O.DOC_FEATURES}
SELECT {O.quality_label('word_count', 'flesch_reading_ease')} AS quality_label, count(*) AS n
FROM feat GROUP BY 1""")
def a1_label_distribution(spark, sf):
    return S.count_by(labelled_docs(spark, sf), "quality_label")


def _describe_sql(cols):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS feature, count({c})::BIGINT AS count, avg({c}::DOUBLE) AS mean,
  stddev_samp({c}::DOUBLE) AS std, min({c}::DOUBLE) AS min,
  quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.5) AS q50,
  quantile_cont({c}::DOUBLE, 0.75) AS q75, max({c}::DOUBLE) AS max FROM feat""")
    return f"WITH {O.DOC_FEATURES}\n" + "\nUNION ALL\n".join(parts)


@register("a3_describe", _describe_sql(FEATURE_COLS))
def a3_describe(spark, sf):
    return S.describe(doc_features(spark, sf), FEATURE_COLS)


def _hist_sql(col, bins, src="feat", feature=None):
    return f"""
SELECT '{feature or col}' AS feature, g.bin, b.lo + g.bin * ((b.hi - b.lo) / {float(bins)}) AS bin_lo,
       b.lo + (g.bin + 1) * ((b.hi - b.lo) / {float(bins)}) AS bin_hi, coalesce(c.n, 0)::BIGINT AS n
FROM (SELECT range::INTEGER AS bin FROM range({bins})) g
CROSS JOIN (SELECT min({col}::DOUBLE) AS lo, max({col}::DOUBLE) AS hi FROM {src}) b
LEFT JOIN (
  SELECT CASE WHEN b2.hi = b2.lo THEN 0
              ELSE least({bins - 1}, floor(({col}::DOUBLE - b2.lo) / ((b2.hi - b2.lo) / {float(bins)})))::INTEGER END AS bin,
         count(*) AS n
  FROM {src}, (SELECT min({col}::DOUBLE) AS lo, max({col}::DOUBLE) AS hi FROM {src}) b2
  WHERE {col} IS NOT NULL GROUP BY 1) c ON c.bin = g.bin"""


@register("a4_histogram", f"WITH {O.DOC_FEATURES}\n" + "\nUNION ALL\n".join(
    _hist_sql(c, 50) for c in FEATURE_COLS))
def a4_histogram(spark, sf):
    # two passes per column (bounds, then counts) over one feature table
    f = hold(doc_features(spark, sf))
    out = None
    for c in FEATURE_COLS:
        h = S.histogram(f, c, 50)
        out = h if out is None else out.unionByName(h)
    return out


@register("a5_mean_median", f"WITH {O.DOC_FEATURES}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, avg({c}::DOUBLE) AS mean, median({c}::DOUBLE) AS median FROM feat"
    for c in FEATURE_COLS))
def a5_mean_median(spark, sf):
    return S.mean_median(doc_features(spark, sf), FEATURE_COLS)


def _box_sql(c):
    return f"""
SELECT '{c}' AS feature, q1, median, q3, lo_fence, hi_fence,
  (SELECT min({c}::DOUBLE) FROM feat WHERE {c} BETWEEN lo_fence AND hi_fence) AS whisker_lo,
  (SELECT max({c}::DOUBLE) FROM feat WHERE {c} BETWEEN lo_fence AND hi_fence) AS whisker_hi,
  (SELECT count(*) FROM feat WHERE {c} < lo_fence OR {c} > hi_fence)::BIGINT AS n_outliers
FROM (SELECT q1, median, q3, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence
      FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS median,
                   quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM feat))"""


@register("a6_box_plot_stats", f"WITH {O.DOC_FEATURES}\n" + "\nUNION ALL\n".join(
    _box_sql(c) for c in FEATURE_COLS))
def a6_box_plot_stats(spark, sf):
    return S.box_plot_stats(doc_features(spark, sf), FEATURE_COLS)


@register("a8_count_rows", """
SELECT 'documents' AS tbl, count(*)::BIGINT AS n FROM documents
UNION ALL SELECT 'pages' AS tbl, count(*)::BIGINT AS n FROM pages
UNION ALL SELECT 'embeddings' AS tbl, count(*)::BIGINT AS n FROM embeddings""")
def a8_count_rows(spark, sf):
    out = None
    for t in ("documents", "pages", "embeddings"):
        c = table(spark, sf, t).agg(F.count(F.lit(1)).cast("long").alias("n")).select(
            F.lit(t).alias("tbl"), "n")
        out = c if out is None else out.unionByName(c)
    return out


@register("o2_head", f"""
WITH {O.DOC_FEATURES}
SELECT doc_id, word_count, sentence_count, flesch_reading_ease FROM feat ORDER BY doc_id LIMIT 100""")
def o2_head(spark, sf):
    return S.head(doc_features(spark, sf), 100, "doc_id")


from . import queries_tfidf  # noqa: E402,F401
