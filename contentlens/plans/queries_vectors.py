"""Registered vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import vectors as V
from ..operators import cells as CELLS
from ..operators import embed as EM
from ..operators import extract as E
from ..operators import similarity as SIM
from ..operators import stats as S
from ..operators.holding import hold
from ..operators.max_pair import max_pair
from . import oracle_sql as O
from .queries_tfidf import _KW_DOCS
from .registry import register, table

DUP_T = 0.80        # reference threshold (text-derived vectors of `documents`)
EMB_T = 0.40        # `embeddings` holds no pair above 0.52: use 0.40 there
SIM_K, SIM_T = 5, 0.70


def _bucket_sql(term: str, dim: int = EM.DEFAULT_DIM) -> str:
    return f"((('0x' || substr(md5({term}), 1, 8))::BIGINT) % {dim})::INTEGER"


def _t14_sql(src: str, id_col: str, text_col: str, prefix: str, corpus_prefix: str | None = None) -> str:
    """CTEs {prefix}tf, {prefix}w, {prefix}v (id, bucket, weight FLOAT) for table ``src``.

    The idf comes from ``corpus_prefix`` statistics when given (fit on another table).
    """
    p = prefix
    cp = corpus_prefix or prefix
    stats = "" if corpus_prefix else f"""
{p}nd AS (SELECT count(*) AS n FROM {src}),
{p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY 1),"""
    return f"""
{p}tf AS (SELECT {id_col} AS id, term, count(*) AS tf FROM (
          SELECT {id_col}, unnest({O.plain_terms(f"coalesce({text_col}, '')")}) AS term FROM {src}) GROUP BY 1, 2),{stats}
{p}w AS (SELECT id, {_bucket_sql('term')} AS bucket,
          sum((tf * (ln((1 + n)::DOUBLE / (1 + coalesce(df, 0))::DOUBLE) + 1))::DECIMAL(38, 18))::DOUBLE AS w
        FROM {p}tf LEFT JOIN {cp}df USING (term), {cp}nd GROUP BY 1, 2),
{p}nrm AS (SELECT id, sqrt(sum((w * w)::DECIMAL(38, 18))::DOUBLE) AS nrm FROM {p}w GROUP BY 1),
{p}v AS (SELECT id, bucket, (w / nrm)::FLOAT AS weight FROM {p}w JOIN {p}nrm USING (id))"""


def doc_vectors(spark, sf):
    return EM.hashed_tfidf(table(spark, sf, "documents"))


# ------------------------------------------------------------------ X12/X13
@register("x12_parse_embedding", """
SELECT vec_id, len(p)::BIGINT AS dims, p = embedding AS exact_roundtrip
FROM (SELECT vec_id, embedding,
        list_transform(string_split(trim(embedding::VARCHAR, '[]'), ','), lambda x: trim(x)::FLOAT) AS p
      FROM embeddings)""")
def x12_parse_embedding(spark, sf):
    e = table(spark, sf, "embeddings")
    p = V.parse_embedding(V.embedding_to_string("embedding"))
    return e.select("vec_id", F.size(p).cast("long").alias("dims"), (p == F.col("embedding")).alias("exact_roundtrip"))


# -------------------------------------------------------------------- T14
@register("t14_embed", f"""
WITH {_t14_sql('documents', 'doc_id', 'text', 'd')}
SELECT id AS doc_id, bucket, round(weight::DOUBLE, 6) AS weight FROM dv""")
def t14_embed(spark, sf):
    lf = EM.long_form(doc_vectors(spark, sf))
    return lf.select("doc_id", "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight"))


# --------------------------------------------------------------------- J1
@register("j1_cosine_next", """
SELECT a.vec_id AS id_1, b.vec_id AS id_2,
       round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def j1_cosine_next(spark, sf):
    e = table(spark, sf, "embeddings")
    a = e.select(F.col("vec_id").alias("id_1"), F.col("embedding").alias("va"))
    b = e.select(F.col("vec_id").alias("id_2"), F.col("embedding").alias("vb"))
    j = a.join(b, F.col("id_2") == F.col("id_1") + 1)
    return j.select("id_1", "id_2", F.round(V.cosine_similarity("va", "vb"), 6).alias("similarity"))


# --------------------------------------------------------------------- J2
@register("j2_similarity_heatmap", """
WITH s AS (SELECT * FROM embeddings ORDER BY vec_id LIMIT 30)
SELECT a.vec_id AS id_1, b.vec_id AS id_2,
       round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity
FROM s a JOIN s b ON a.vec_id < b.vec_id""")
def j2_similarity_heatmap(spark, sf):
    # The heatmap is drawn for a 30-page sample: that sample is the feature.
    e = S.head(table(spark, sf, "embeddings"), 30, "vec_id")
    m = SIM.similarity_matrix(SIM.as_vectors(e, "vec_id", "embedding"))
    return m.select("id_1", "id_2", F.round("similarity", 4).alias("similarity"))


# --------------------------------------------------------------------- J3
_EMB_GROUPS = """
g AS (SELECT embedding, min(vec_id) AS rep, count(*)::BIGINT AS copies FROM embeddings
      WHERE embedding IS NOT NULL GROUP BY embedding),
r AS (SELECT * FROM g WHERE list_bool_or(list_transform(embedding, lambda x: x <> 0)))"""


@register("j3_duplicate_pairs_embeddings", f"""
WITH {_EMB_GROUPS}
SELECT a.rep AS id_1, b.rep AS id_2,
       round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity,
       a.copies AS copies_1, b.copies AS copies_2
FROM r a JOIN r b ON a.rep < b.rep
WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > {EMB_T}""")
def j3_duplicate_pairs_embeddings(spark, sf):
    v = SIM.as_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding")
    pairs, _ = SIM.duplicate_pairs(v, EMB_T)
    return pairs.select("id_1", "id_2", F.round("similarity", 4).alias("similarity"), "copies_1", "copies_2")


_DOC_PAIRS = f"""{_t14_sql('documents', 'doc_id', 'text', 'd')},
dl AS (SELECT id, list(struct_pack(b := bucket, w := weight) ORDER BY bucket) AS v FROM dv GROUP BY id),
da AS (SELECT d.doc_id AS id, coalesce(dl.v, []) AS v FROM documents d LEFT JOIN dl ON dl.id = d.doc_id),
dg AS (SELECT v, min(id) AS rep, count(*)::BIGINT AS copies FROM da GROUP BY v),
cw AS (SELECT rep, e.b AS b, e.w::DOUBLE AS w FROM (SELECT rep, unnest(v) AS e FROM dg WHERE len(v) > 0)),
cn AS (SELECT rep, sqrt(sum(w * w)) AS nrm FROM cw GROUP BY rep),
dots AS (SELECT a.rep AS id_1, b.rep AS id_2, sum(a.w * b.w) AS dot
         FROM cw a JOIN cw b ON a.b = b.b AND a.rep < b.rep GROUP BY 1, 2),
sims AS (SELECT id_1, id_2, dot / (n1.nrm * n2.nrm) AS sim
         FROM dots JOIN cn n1 ON n1.rep = id_1 JOIN cn n2 ON n2.rep = id_2),
feat_wc AS (SELECT doc_id, {O.word_count("coalesce(text, '')")} AS wc FROM documents),
rp AS (SELECT s.id_1, s.id_2, s.sim, g1.copies AS copies_1, g2.copies AS copies_2
       FROM sims s JOIN dg g1 ON g1.rep = s.id_1 JOIN dg g2 ON g2.rep = s.id_2 WHERE s.sim > {DUP_T})"""


@register("j3_duplicate_pairs_documents", f"""
WITH {_DOC_PAIRS}
SELECT id_1, id_2, 'doc:' || id_1::VARCHAR AS url_1, 'doc:' || id_2::VARCHAR AS url_2,
       round(sim, 4) AS similarity, w1.wc AS word_count_1, w2.wc AS word_count_2, copies_1, copies_2
FROM rp JOIN feat_wc w1 ON w1.doc_id = id_1 JOIN feat_wc w2 ON w2.doc_id = id_2""")
def j3_duplicate_pairs_documents(spark, sf):
    docs = table(spark, sf, "documents")
    v = SIM.as_vectors(EM.hashed_tfidf(docs), "doc_id", sparse=("indices", "values"))
    pairs, _ = SIM.duplicate_pairs(v, DUP_T)
    meta = E.documents_as_content(docs).select(
        F.col("doc_id").alias("id"), "url", E.X.word_count("body_text").alias("word_count"))
    out = SIM.attach_metadata(pairs, meta)
    return out.select("id_1", "id_2", "url_1", "url_2", F.round("similarity", 4).alias("similarity"),
                      "word_count_1", "word_count_2", "copies_1", "copies_2")


@register("j3_candidate_pairs_documents")
def j3_candidate_pairs_documents(spark, sf):
    """Pairs by hashed candidates: a subset of ``j3_duplicate_pairs_documents`` of the stated recall, so without a twin."""
    v = SIM.as_vectors(doc_vectors(spark, sf), "doc_id", sparse=("indices", "values"))
    pairs, _ = SIM.duplicate_pairs(v, DUP_T, recall=0.95)
    return pairs.select("id_1", "id_2", F.round("similarity", 4).alias("similarity"), "copies_1", "copies_2")


@register("j3_copy_groups_documents", f"""
WITH {_DOC_PAIRS}
SELECT rep, copies, len(v) = 0 AS is_zero, 1.0::DOUBLE AS similarity FROM dg WHERE copies >= 2""")
def j3_copy_groups_documents(spark, sf):
    v = SIM.as_vectors(doc_vectors(spark, sf), "doc_id", sparse=("indices", "values"))
    _, groups = SIM.duplicate_pairs(v, DUP_T)
    return groups


@register("j3_copy_members_documents", f"""
WITH {_DOC_PAIRS}
SELECT dg.rep, da.id, 'doc:' || da.id::VARCHAR AS url, feat_wc.wc AS word_count
FROM da JOIN dg USING (v) JOIN feat_wc ON feat_wc.doc_id = da.id WHERE dg.copies >= 2""")
def j3_copy_members_documents(spark, sf):
    docs, v, _, groups = _doc_dups(spark, sf)
    meta = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"),
                       E.X.word_count("text").alias("word_count"))
    return SIM.copy_members(v, groups).join(meta, "id").select("rep", "id", "url", "word_count")


# brute-force flat form (every member pair), used by A2 / A7 twins
_FLAT = """
mem AS (SELECT da.id, dg.rep FROM da JOIN dg USING (v)),
flat AS (
  SELECT a.id AS i, b.id AS j FROM mem a JOIN mem b ON a.rep = b.rep AND a.id < b.id
  UNION ALL
  SELECT m1.id AS i, m2.id AS j FROM rp JOIN mem m1 ON m1.rep = rp.id_1 JOIN mem m2 ON m2.rep = rp.id_2)"""


def _doc_dups(spark, sf, totals=False):
    docs = table(spark, sf, "documents")
    v = SIM.as_vectors(EM.hashed_tfidf(docs), "doc_id", sparse=("indices", "values"))
    pairs, groups = SIM.duplicate_pairs(v, DUP_T, totals=totals)
    return docs, v, pairs, groups


@register("a2_summary_stats", f"""
WITH {_DOC_PAIRS}, {_FLAT}
SELECT (SELECT count(*) FROM documents)::BIGINT AS total_pages,
       (SELECT count(*) FROM flat)::BIGINT AS duplicate_pairs,
       (SELECT count(*) FROM feat_wc WHERE wc < 500)::BIGINT AS thin_pages,
       500::BIGINT AS thin_threshold, {DUP_T}::DOUBLE AS similarity_threshold""")
def a2_summary_stats(spark, sf):
    docs, _, pairs, groups = _doc_dups(spark, sf, totals=True)
    total = docs.agg(F.count(F.lit(1)).cast("long").alias("total_pages"))
    thin = docs.agg(F.count(F.when(L.is_thin(E.X.word_count("text")), 1)).cast("long").alias("thin_pages"))
    out = S.attach_scalars(S.attach_scalars(total, SIM.pair_count(pairs, groups)), thin)
    return out.select("total_pages", "duplicate_pairs", "thin_pages",
                      F.lit(L.THIN_WORDS).cast("long").alias("thin_threshold"),
                      F.lit(DUP_T).alias("similarity_threshold"))


@register("a7_describe_pairs", f"""
WITH {_DOC_PAIRS}, {_FLAT}
SELECT max(greatest(w1.wc, w2.wc))::BIGINT AS max_word_count, count(*)::BIGINT AS n_pairs
FROM flat JOIN feat_wc w1 ON w1.doc_id = i JOIN feat_wc w2 ON w2.doc_id = j""")
def a7_describe_pairs(spark, sf):
    docs, v, pairs, groups = _doc_dups(spark, sf, totals=True)
    pairs = hold(pairs)  # read for the representatives and for the count
    reps = pairs.select("rep").unionByName(groups.select("rep")).distinct()
    allg = SIM.collapse_copies(v).select("rep", "indices", "values")
    members = v.join(allg, ["indices", "values"]).join(reps, "rep", "left_semi").select("id")
    wc = docs.select(F.col("doc_id").alias("id"), E.X.word_count("text").alias("wc"))
    mx = members.join(wc, "id").agg(F.max("wc").cast("long").alias("max_word_count"))
    return S.attach_scalars(mx, SIM.pair_count(pairs, groups)).select(
        "max_word_count", F.col("duplicate_pairs").alias("n_pairs"))


# --------------------------------------------------------------------- J4
_J4 = f"""{_t14_sql('documents', 'doc_id', 'text', 'd')},
{_t14_sql('benchmark', 'item_id', 'text', 'q', corpus_prefix='d')},
qn AS (SELECT id, sqrt(sum(weight::DOUBLE * weight::DOUBLE)) AS nrm FROM qv GROUP BY 1),
cn AS (SELECT id, sqrt(sum(weight::DOUBLE * weight::DOUBLE)) AS nrm FROM dv GROUP BY 1),
dots AS (SELECT q.id AS qid, c.id AS id, sum(q.weight::DOUBLE * c.weight::DOUBLE) AS dot
         FROM qv q JOIN dv c ON q.bucket = c.bucket GROUP BY 1, 2),
sims AS (SELECT qid, dots.id, round(dot / (qn.nrm * cn.nrm), 9) AS sim FROM dots
         JOIN qn ON qn.id = qid JOIN cn ON cn.id = dots.id),
top AS (SELECT qid, id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank
        FROM sims WHERE sim >= {SIM_T})"""


def _j4(spark, sf):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    cvec, term_df, n = EM.fit(docs)
    corpus = SIM.as_vectors(cvec, "doc_id", sparse=("indices", "values"))
    qs = SIM.as_vectors(EM.encode(bench, term_df, n, id_col="item_id"), "item_id",
                        sparse=("indices", "values"))
    return SIM.similar_pages(qs, corpus, SIM_K, SIM_T)


@register("j4_similar_pages", f"""
WITH {_J4}
SELECT qid AS item_id, rank::BIGINT AS rank, id AS doc_id, round(sim, 4) AS similarity FROM top WHERE rank <= {SIM_K}""")
def j4_similar_pages(spark, sf):
    r = _j4(spark, sf)
    return r.select(F.col("qid").alias("item_id"), F.col("rank").cast("long").alias("rank"),
                    F.col("id").alias("doc_id"), F.round("similarity", 4).alias("similarity"))


@register("j8_max_similarity", f"""
WITH {_J4}
SELECT qid AS item_id, round(max(sim), 4) AS max_similarity,
       CASE WHEN max(sim) > 0.8 THEN 'High' WHEN max(sim) > 0.7 THEN 'Moderate' END AS similarity_band,
       (round(round(max(sim), 4) * 100, 1))::VARCHAR || '%' AS max_percent
FROM top WHERE rank <= {SIM_K} GROUP BY qid""")
def j8_max_similarity(spark, sf):
    r = _j4(spark, sf).withColumn("similarity", F.round("similarity", 4))
    g = r.groupBy("qid").agg(F.max("similarity").alias("max_similarity"))
    return g.select(F.col("qid").alias("item_id"), "max_similarity",
                    L.similarity_band("max_similarity").alias("similarity_band"),
                    L.format_percent("max_similarity").alias("max_percent"))


# J4 / J8 with documents as queries (J4: every 20th id, the stated query set) against all documents
def _j4_docs_sql(asked: str = "") -> str:
    return f"""{_t14_sql('documents', 'doc_id', 'text', 'd')},
cn AS (SELECT id, sqrt(sum(weight::DOUBLE * weight::DOUBLE)) AS nrm FROM dv GROUP BY 1),
dots AS (SELECT q.id AS qid, c.id AS id, sum(q.weight::DOUBLE * c.weight::DOUBLE) AS dot
         FROM dv q JOIN dv c ON q.bucket = c.bucket {asked}AND q.id <> c.id GROUP BY 1, 2),
sims AS (SELECT qid, dots.id, round(dot / (a.nrm * b.nrm), 9) AS sim FROM dots JOIN cn a ON a.id = qid JOIN cn b ON b.id = dots.id),
top AS (SELECT qid, id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank
        FROM sims WHERE sim >= {SIM_T})"""


_J4_DOCS = _j4_docs_sql("AND q.id % 20 = 0 ")


def _j4_cells(spark, sf, asked=None):
    v = SIM.as_vectors(doc_vectors(spark, sf), "doc_id", sparse=("indices", "values"))
    index = CELLS.build_cells(v)
    queries = index.rows if asked is None else index.rows.filter(asked)
    return CELLS.search_cells(queries.drop("cell", "angle"), index, SIM_K, SIM_T, exclude_self=True)


def _j4_docs(spark, sf, asked=None):
    v = SIM.as_vectors(doc_vectors(spark, sf), "doc_id", sparse=("indices", "values"))
    return SIM.similar_pages(v if asked is None else v.filter(asked), v, SIM_K, SIM_T, exclude_self=True)


@register("j4_cell_search_documents", f"""
WITH {_J4_DOCS}
SELECT qid, rank::BIGINT AS rank, id AS doc_id, round(sim, 4) AS similarity FROM top WHERE rank <= {SIM_K}""")
def j4_cell_search_documents(spark, sf):
    """``j4_similar_documents`` through the index: the same rows."""
    found, _ = _j4_cells(spark, sf, F.col("id") % 20 == 0)
    return found.select("qid", F.col("rank").cast("long").alias("rank"), F.col("id").alias("doc_id"), F.round("similarity", 4).alias("similarity"))


@register("j4_cells_visited_documents")
def j4_cells_visited_documents(spark, sf):
    """Cells of the index that each query reads, of all that hold rows; depends on the centres, so without a twin."""
    return _j4_cells(spark, sf)[1]


@register("j4_similar_documents", f"""
WITH {_J4_DOCS}
SELECT qid, rank::BIGINT AS rank, id AS doc_id, round(sim, 4) AS similarity FROM top WHERE rank <= {SIM_K}""")
def j4_similar_documents(spark, sf):
    found = _j4_docs(spark, sf, F.col("id") % 20 == 0)
    return found.select("qid", F.col("rank").cast("long").alias("rank"), F.col("id").alias("doc_id"), F.round("similarity", 4).alias("similarity"))


@register("j8_max_similarity_documents", f"""
WITH {_j4_docs_sql()}
SELECT qid, round(max(sim), 4) AS max_similarity,
       CASE WHEN round(max(sim), 4) > 0.8 THEN 'High' WHEN round(max(sim), 4) > 0.7 THEN 'Moderate' END AS similarity_band,
       (round(round(max(sim), 4) * 100, 1))::VARCHAR || '%' AS max_percent
FROM top WHERE rank <= {SIM_K} GROUP BY qid""")
def j8_max_similarity_documents(spark, sf):
    r = _j4_docs(spark, sf).withColumn("similarity", F.round("similarity", 4))
    g = r.groupBy("qid").agg(F.max("similarity").alias("max_similarity"))
    return g.select("qid", "max_similarity", L.similarity_band("max_similarity").alias("similarity_band"),
                    L.format_percent("max_similarity").alias("max_percent"))


# --------------------------------------------------------------------- J7
@register("j7_upper_triangle_stats", """
SELECT count(*)::BIGINT AS n_pairs, round(avg(s), 6) AS mean_similarity, round(max(s), 6) AS max_similarity
FROM (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
      FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)""")
def j7_upper_triangle_stats(spark, sf):
    v = SIM.as_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding")
    st = SIM.upper_triangle_stats(v)
    return st.select("n_pairs", F.round("mean_similarity", 6).alias("mean_similarity"),
                     F.round("max_similarity", 6).alias("max_similarity"))


@register("j7_max_similarity_documents", f"""
WITH {_DOC_PAIRS}
SELECT count(*)::BIGINT AS texts, (SELECT round(max(sim), 6) FROM sims) AS max_similarity FROM dg WHERE len(v) > 0""")
def j7_max_similarity_documents(spark, sf):
    """Greatest similarity of two different, non-empty document vectors."""
    v = SIM.as_vectors(EM.hashed_tfidf(table(spark, sf, "documents")), "doc_id", sparse=("indices", "values"))
    groups = hold(SIM.collapse_copies(v).filter(~F.col("is_zero")))
    best = max_pair(groups.select(F.col("rep").alias("id"), "indices", "values")).similarity
    return groups.agg(F.count(F.lit(1)).alias("texts")).select("texts", F.round(F.lit(best).cast("double"), 6).alias("max_similarity"))


# --------------------------------------------------------------------- T15
@register("t15_build_features", f"""
WITH {O.DOC_FEATURES}, {_t14_sql('documents', 'doc_id', 'text', 'd')}, {_KW_DOCS},
rk AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, term) AS r FROM nw WHERE weight > 0),
kw AS (SELECT doc_id, string_agg(term, ', ' ORDER BY r) AS top_keywords FROM rk WHERE r <= 5 GROUP BY 1),
vs AS (SELECT id, string_agg(bucket::VARCHAR || ':' || round(weight::DOUBLE * 10000)::BIGINT::VARCHAR, ' ' ORDER BY bucket) AS cells
       FROM dv GROUP BY 1)
SELECT 'doc:' || f.doc_id::VARCHAR AS url, f.word_count, f.sentence_count, f.flesch_reading_ease,
       coalesce(kw.top_keywords, '') AS top_keywords, coalesce(vs.cells, '') AS embedding_cells
FROM feat f LEFT JOIN vs ON vs.id = f.doc_id LEFT JOIN kw ON kw.doc_id = f.doc_id""")
def t15_build_features(spark, sf):
    from .jobs import build_features
    f = build_features(table(spark, sf, "documents"), id_col="doc_id", text_col="text")
    cell = F.zip_with("embedding_indices", "embedding_values", lambda i, w: F.concat(
        i.cast("string"), F.lit(":"), F.round(w.cast("double") * 10000).cast("long").cast("string")))
    return f.select("url", "word_count", "sentence_count", "flesch_reading_ease",
                    F.array_join("top_keywords", ", ").alias("top_keywords"), F.array_join(cell, " ").alias("embedding_cells"))


from . import queries_model  # noqa: E402,F401
