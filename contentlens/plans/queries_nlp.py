"""Registered NLP queries: sentiment (T7-T9, P7), entities (T10-T12), topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.resources import (BOOSTER_INCREMENT, BOOSTERS, ENGLISH_STOPWORDS, NEGATION_SCALAR,
                                   NEGATIONS, SEED_GAZETTEER, SEED_LEXICON, SENTIMENT_ALPHA)
from ..operators import entities as ENT
from ..operators import sentences as SENT
from ..operators import sentiment as SEN
from ..operators import stats as S
from ..operators import topics as TOP
from ..operators.holding import hold
from . import oracle_sql as O
from .queries import _hist_sql
from .registry import register, table


def _values(rows, cols):
    body = ", ".join("(" + ", ".join(O.q(v) if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) v({', '.join(cols)}))"


_RES = f"""
res AS (SELECT term, max(valence) AS valence, bool_or(is_neg) AS is_neg, sum(dir) AS dir FROM (
          SELECT term, valence::DOUBLE AS valence, false AS is_neg, 0 AS dir FROM {_values(SEED_LEXICON, ['term', 'valence'])}
          UNION ALL SELECT term, NULL::DOUBLE, true, 0 FROM {_values([(w,) for w in NEGATIONS], ['term'])}
          UNION ALL SELECT term, NULL::DOUBLE, false, dir FROM {_values(BOOSTERS, ['term', 'dir'])}) GROUP BY term)"""

_SENT = f"""{_RES},
base AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                regexp_extract_all(lower(coalesce(text, '')), {O.q(SEN.SENT_TOKEN)}) AS tok FROM documents),
b2 AS (SELECT doc_id, len, tok, CASE WHEN len > {SEN.MIN_CHARS} THEN len(tok) ELSE 0 END AS ntok FROM base),
toks AS (SELECT doc_id, unnest(tok) AS term, generate_subscripts(tok, 1) AS pos FROM b2 WHERE len > {SEN.MIN_CHARS}),
hits AS (SELECT doc_id, pos, valence, is_neg, dir FROM toks JOIN res USING (term)),
sc AS (SELECT h.doc_id, h.pos, any_value(h.valence) AS valence,
              count(*) FILTER (WHERE c.is_neg) AS k,
              coalesce(sum(c.dir * {BOOSTER_INCREMENT} * CASE h.pos - c.pos WHEN 1 THEN {SEN.DECAY[1]}
                            WHEN 2 THEN {SEN.DECAY[2]} ELSE {SEN.DECAY[3]} END), 0.0) AS b
       FROM hits h LEFT JOIN hits c ON c.doc_id = h.doc_id AND c.pos BETWEEN h.pos - 3 AND h.pos - 1
       WHERE h.valence IS NOT NULL GROUP BY h.doc_id, h.pos),
s AS (SELECT doc_id, (valence + sign(valence) * b) * pow({NEGATION_SCALAR}, k) AS s FROM sc),
pd AS (SELECT doc_id, sum(s) AS sum_s, sum(CASE WHEN s > 0 THEN s + 1 END) AS pos_sum,
              sum(CASE WHEN s < 0 THEN s - 1 END) AS neg_sum, count(*) FILTER (WHERE s <> 0) AS n_scored
       FROM s GROUP BY 1),
j AS (SELECT b2.doc_id, coalesce(sum_s, 0.0) AS sum_s, coalesce(pos_sum, 0.0) AS pos_sum,
             coalesce(neg_sum, 0.0) AS neg_sum, (ntok - coalesce(n_scored, 0))::DOUBLE AS neu
      FROM b2 LEFT JOIN pd USING (doc_id)),
sent AS (SELECT doc_id,
    CASE WHEN pos_sum + abs(neg_sum) + neu > 0 THEN round(abs(neg_sum / (pos_sum + abs(neg_sum) + neu)), 3) ELSE 0.0 END AS neg,
    CASE WHEN pos_sum + abs(neg_sum) + neu > 0 THEN round(abs(neu / (pos_sum + abs(neg_sum) + neu)), 3) ELSE 0.0 END AS neu,
    CASE WHEN pos_sum + abs(neg_sum) + neu > 0 THEN round(abs(pos_sum / (pos_sum + abs(neg_sum) + neu)), 3) ELSE 0.0 END AS pos,
    round(least(1.0, greatest(-1.0, sum_s / sqrt(sum_s * sum_s + {SENTIMENT_ALPHA}))), 4) AS compound
  FROM j),
lab AS (SELECT *, CASE WHEN compound > 0.05 THEN 'Positive' WHEN compound < -0.05 THEN 'Negative'
                       ELSE 'Neutral' END AS sentiment FROM sent)"""


def _scores(spark, sf):
    return SEN.sentiment_scores(table(spark, sf, "documents"))


@register("t7_sentiment", f"""
WITH {_SENT}
SELECT doc_id, neg, neu, pos, compound, sentiment FROM lab""")
def t7_sentiment(spark, sf):
    return _scores(spark, sf)


@register("t8_sentiment_distribution", f"""
WITH {_SENT}
SELECT sentiment, count(*)::BIGINT AS n FROM lab GROUP BY 1""")
def t8_sentiment_distribution(spark, sf):
    return SEN.sentiment_distribution(_scores(spark, sf))


@register("t9_sentiment_means", f"""
WITH {_SENT}
SELECT round(avg(pos), 6) AS pos, round(avg(neu), 6) AS neu, round(avg(neg), 6) AS neg FROM lab""")
def t9_sentiment_means(spark, sf):
    m = SEN.sentiment_means(_scores(spark, sf))
    return m.select(*[F.round(c, 6).alias(c) for c in ("pos", "neu", "neg")])


@register("a4_compound_histogram", f"WITH {_SENT}\n" + _hist_sql("compound", 30, src="lab"))
def a4_compound_histogram(spark, sf):
    return S.histogram(_scores(spark, sf), "compound", 30)


# --------------------------------------------------------------- entities
_GAZ = _values(SEED_GAZETTEER, ["phrase", "type"])
_STOP = O.STOP_LIST


def _lead_trim(r: str) -> str:
    pos = f"coalesce(list_position(list_transform(string_split({r}, ' '), lambda w: list_contains({_STOP}, lower(w))), false), 0)"
    return f"CASE WHEN {pos} > 0 THEN array_to_string(string_split({r}, ' ')[{pos}:], ' ') END"


_ENTS = f"""
c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {O.q(ENT.CAPITALISED_RUN)}) AS runs FROM documents
      WHERE length(coalesce(text, '')) >= {ENT.MIN_CHARS}),
e AS (SELECT doc_id, list_filter(list_transform(runs, lambda r: {_lead_trim('r')}), lambda x: x IS NOT NULL) AS ents FROM c),
x AS (SELECT doc_id, unnest(ents) AS entity, generate_subscripts(ents, 1) - 1 AS idx FROM e),
g AS (SELECT phrase, min(type) AS type FROM {_GAZ} GROUP BY 1),
x2 AS (SELECT *, CASE WHEN len(string_split(entity, ' ')) >= 2
                      THEN array_to_string(string_split(entity, ' ')[2:], ' ') END AS tail FROM x),
ent AS (SELECT doc_id, idx::INTEGER AS idx,
               CASE WHEN g1.type IS NULL AND g2.type IS NOT NULL THEN tail ELSE entity END AS entity,
               coalesce(g1.type, g2.type, 'UNKNOWN') AS type
        FROM x2 LEFT JOIN g g1 ON g1.phrase = x2.entity LEFT JOIN g g2 ON g2.phrase = x2.tail)"""


def _entities(spark, sf):
    return ENT.extract_entities(table(spark, sf, "documents"))


@register("t10_entities", f"""
WITH {_ENTS}
SELECT doc_id, idx, entity, type FROM ent""")
def t10_entities(spark, sf):
    return _entities(spark, sf)


# A gazetteer from the tables: the opening of every benchmark passage (its first one to three words, by the item's number).
_OPENINGS = f"""
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), {O.q(ENT.NGRAM_WORD)}) AS w FROM benchmark),
p AS (SELECT array_to_string(w[:n], ' ') AS phrase, min('OPENING ' || n::VARCHAR) AS type
      FROM (SELECT w, (item_id % 3 + 1)::INTEGER AS n FROM b) WHERE len(w) >= n GROUP BY 1),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {O.q(ENT.NGRAM_WORD)}) AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(len(w))) AS start FROM d),
g AS (SELECT doc_id, start, n, array_to_string(w[start + 1:start + n], ' ') AS phrase FROM s, (VALUES (1), (2), (3)) t(n) WHERE start + n <= len(w)),
f AS MATERIALIZED (SELECT doc_id, start, max(n) AS n, arg_max(phrase, n) AS phrase, arg_max(type, n) AS type FROM g JOIN p USING (phrase) GROUP BY 1, 2),
k(doc_id, start, n, phrase, type) AS (
  SELECT doc_id, min(start), arg_min(n, start), arg_min(phrase, start), arg_min(type, start) FROM f GROUP BY doc_id
  UNION ALL
  SELECT f.doc_id, min(f.start), arg_min(f.n, f.start), arg_min(f.phrase, f.start), arg_min(f.type, f.start)
  FROM k JOIN f ON f.doc_id = k.doc_id AND f.start >= k.start + k.n GROUP BY f.doc_id)"""


def _openings(spark, sf):
    bench = table(spark, sf, "benchmark")
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(ENT.NGRAM_WORD), 0)
    n = (F.col("item_id") % 3 + 1).cast("int")
    return bench.select(words.alias("w"), n.alias("n")).filter("size(w) >= n").select(
        F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("phrase"), F.concat(F.lit("OPENING "), F.col("n").cast("string")).alias("type"))


@register("t10_gazetteer_matches", f"""
WITH RECURSIVE {_OPENINGS}
SELECT doc_id, start::INTEGER AS start, n AS n_words, phrase, type FROM k""")
def t10_gazetteer_matches(spark, sf):
    return ENT.gazetteer_matches(table(spark, sf, "documents"), _openings(spark, sf))


@register("t10_entities_with_gazetteer", f"""
WITH RECURSIVE {_OPENINGS},
c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {O.q(ENT.CAPITALISED_RUN)}) AS runs FROM documents),
e AS (SELECT doc_id, unnest(list_filter(list_transform(runs, lambda r: {_lead_trim('r')}), lambda x: x IS NOT NULL)) AS entity FROM c),
u AS (SELECT doc_id, entity FROM e WHERE NOT EXISTS (
      SELECT 1 FROM k WHERE k.doc_id = e.doc_id AND contains(' ' || lower(entity) || ' ', ' ' || phrase || ' ')))
SELECT doc_id, entity, type, count(*)::BIGINT AS n FROM (
  SELECT doc_id, phrase AS entity, type FROM k UNION ALL SELECT doc_id, entity, 'UNKNOWN' AS type FROM u) GROUP BY 1, 2, 3""")
def t10_entities_with_gazetteer(spark, sf):
    return ENT.entities_with_gazetteer(table(spark, sf, "documents"), _openings(spark, sf))


@register("t11_top_entity_types", f"""
WITH {_ENTS}
SELECT type, count(*)::BIGINT AS n FROM ent GROUP BY 1 ORDER BY n DESC, type LIMIT 10""")
def t11_top_entity_types(spark, sf):
    return ENT.top_entity_types(_entities(spark, sf), 10)


# A gazetteer from the tables: the entity that opens a document names that document's language.
_DERIVED = _ENTS.replace(f"FROM {_GAZ} GROUP BY 1", """FROM (SELECT ents[1] AS phrase, 'LANG ' || lang AS type
      FROM e JOIN documents USING (doc_id) WHERE len(ents) > 0) GROUP BY 1""")


def _derived_entities(spark, sf):
    docs = table(spark, sf, "documents")
    first = F.get(ENT.entity_candidates("text"), 0)
    gaz = docs.filter(F.length("text") >= ENT.MIN_CHARS).select(
        first.alias("phrase"), F.concat(F.lit("LANG "), F.col("lang")).alias("type")).filter("phrase IS NOT NULL")
    return ENT.extract_entities(docs, gazetteer=gaz)


@register("t11_entity_types_by_language", f"""
WITH {_DERIVED}
SELECT type, count(*)::BIGINT AS n FROM ent GROUP BY 1 ORDER BY n DESC, type LIMIT 10""")
def t11_entity_types_by_language(spark, sf):
    return ENT.top_entity_types(_derived_entities(spark, sf), 10)


@register("t12_top_entities", f"""
WITH {_ENTS}
SELECT entity, count(*)::BIGINT AS n FROM ent GROUP BY 1 ORDER BY n DESC, entity LIMIT 15""")
def t12_top_entities(spark, sf):
    return ENT.top_entities(_entities(spark, sf), 15)


# -------------------------------------------------- sentences (X8, learnt)
def _core_sql(w):
    return f"regexp_extract({w}, {O.q(SENT.CORE)}, 1)"


def _type_sql(core):
    bare = f"lower(CASE WHEN regexp_matches({core}, {O.q(SENT.ONE_PERIOD)}) THEN {core}[:-2] ELSE {core} END)"
    return f"CASE WHEN regexp_matches({bare}, {O.q(SENT.TYPE)}) THEN {bare} END"


_TYPES = f"""
sd AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {O.q(X.WORD)}) AS ws FROM documents),
si AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM sd),
sw AS (SELECT doc_id, CASE WHEN i > 1 THEN ws[i - 1] END AS before, ws[i] AS word,
              CASE WHEN i < len(ws) THEN ws[i + 1] END AS after, {_core_sql('ws[i]')} AS core FROM si),
st AS (SELECT *, {_type_sql('core')} AS type FROM sw),
tc AS (SELECT type, count(*) FILTER (WHERE regexp_matches(core, {O.q(SENT.ONE_PERIOD)})) AS n_period,
              count(*) FILTER (WHERE NOT regexp_matches(core, {O.q(SENT.ONE_PERIOD)})) AS n_plain,
              count(*) FILTER (WHERE regexp_matches(core, '^\\p{{Ll}}')) AS n_lower,
              count(*) FILTER (WHERE regexp_matches(core, '^\\p{{Lu}}') AND before IS NOT NULL
                                     AND NOT regexp_matches(before, {O.q(SENT.BREAK_BEFORE)})) AS n_inside
       FROM st WHERE type IS NOT NULL GROUP BY 1),
tr AS (SELECT sum(n_period)::DOUBLE / sum(n_period + n_plain)::DOUBLE AS rate FROM tc),
tl AS (SELECT *, length(replace(type, '.', ''))::DOUBLE AS letters FROM tc, tr),
ts AS (SELECT *, CASE WHEN n_period > 0 THEN greatest(0.0::DOUBLE,
              -2.0::DOUBLE * (n_period * ln(greatest(rate, 1e-300::DOUBLE)) + n_plain * ln(greatest(1 - rate, 1e-300::DOUBLE))
                      - n_period * ln({SENT.ABBREVIATION_RATE}::DOUBLE) - n_plain * ln({1.0 - SENT.ABBREVIATION_RATE}::DOUBLE))
              * exp(-letters) * (length(type) - letters + 1) * pow(letters, -n_plain::DOUBLE)) ELSE 0.0::DOUBLE END AS score FROM tl),
types AS (SELECT *, (length(type) = 1 AND n_period > 0) OR score >= {SENT.ABBREVIATION_SCORE} AS is_abbreviation FROM ts)"""


@register("x8_sentence_types", f"""
WITH {_TYPES}
SELECT type, n_period, n_plain, n_lower, n_inside, round(score, 6) AS score, is_abbreviation FROM types""")
def x8_sentence_types(spark, sf):
    return SENT.sentence_types(table(spark, sf, "documents")).withColumn("score", F.round("score", 6))


@register("x8_sentence_count_learnt", f"""
WITH {_TYPES},
nx AS (SELECT doc_id, type, {_core_sql('after')} AS nc FROM st
       WHERE regexp_matches(word, {O.q(SENT.PERIOD_END)}) AND after IS NOT NULL AND NOT regexp_matches(after, '^[.!?]')),
wi AS (SELECT doc_id, count(*) AS n FROM nx JOIN types a ON a.type = nx.type AND a.is_abbreviation
       WHERE NOT EXISTS (SELECT 1 FROM types s WHERE s.n_lower > 0 AND s.n_inside = 0 AND regexp_matches(nx.nc, '^\\p{{Lu}}')
                         AND s.type = {_type_sql('nx.nc')}) GROUP BY 1)
SELECT doc_id, (len(regexp_extract_all(t, {O.q(SENT.END)}))
                + CASE WHEN regexp_matches(t, {O.q(f'[^{X.SPACES}]')}) AND NOT regexp_matches(t, {O.q(SENT.CLOSED)}) THEN 1 ELSE 0 END
                - coalesce(wi.n, 0))::BIGINT AS sentence_count
FROM sd LEFT JOIN wi USING (doc_id)""")
def x8_sentence_count_learnt(spark, sf):
    docs = table(spark, sf, "documents")
    return SENT.sentence_counts(docs, hold(SENT.sentence_types(docs)))


# ----------------------------------------------------------------- topics
def _lda(spark, sf):
    docs = table(spark, sf, "documents")
    vecs, terms = TOP.doc_term_vectors(docs)
    return TOP.fit_topics(vecs), vecs, terms


@register("t5_topic_model")
def t5_topic_model(spark, sf):
    model, vecs, _ = _lda(spark, sf)
    weights = TOP.document_topics(model, vecs)
    return weights.select("doc_id", "dominant_topic", F.posexplode("topic_weights").alias("topic", "weight"))


@register("t6_topic_terms")
def t6_topic_terms(spark, sf):
    model, _, terms = _lda(spark, sf)
    return TOP.topic_terms(model, terms, 10)


from . import queries_jobs  # noqa: E402,F401
