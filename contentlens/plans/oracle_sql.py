"""Building blocks of the DuckDB oracle SQL.

The SQL twins reuse the very pattern constants the Spark expressions use, so
the two engines run the same regular expressions (Java and RE2 agree on every
construct used here; the syllable counter, which needs a look-around in Java,
is written with list functions on the SQL side).
"""

from __future__ import annotations

from ..functions import html as H
from ..functions import text as X
from ..functions.resources import ENGLISH_STOPWORDS, sql_string_list


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


STOP_LIST = f"[{sql_string_list(ENGLISH_STOPWORDS)}]"


def strip_outer(e: str) -> str:
    return f"regexp_replace({e}, {q(X.OUTER)}, '', 'g')"


def clean_ws(e: str) -> str:
    return f"trim(regexp_replace({e}, {q(X.WS_RUN)}, ' ', 'g'))"


#: References that the test tables hold; the Spark side decodes every one.
COMMON_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"),
                   ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&amp;", "&")]


def decode(e: str) -> str:
    for ent, ch in COMMON_ENTITIES:
        e = f"replace({e}, {q(ent)}, {q(ch)})"
    return e


def word_count(e: str) -> str:
    return f"len(regexp_extract_all({e}, {q(X.WORD)}))::BIGINT"


def sentence_count(e: str) -> str:
    return f"len(regexp_extract_all({e}, {q(X.SENTENCE)}))::BIGINT"


def syllable_count(e: str) -> str:
    return (f"coalesce(list_sum(list_transform(regexp_extract_all(lower({e}), {q(X.WORD)}), "
            f"lambda w: greatest(1, len(regexp_extract_all(w, {q(X.VOWEL_GROUP)}))))), 0)::BIGINT")


def flesch(wc: str, sc: str, syl: str) -> str:
    return (f"CASE WHEN {wc} > 0 THEN round(206.835::DOUBLE - 1.015::DOUBLE * ({wc}::DOUBLE / "
            f"greatest({sc}, 1)::DOUBLE) - 84.6::DOUBLE * ({syl}::DOUBLE / {wc}::DOUBLE), 2) "
            f"ELSE 0.0::DOUBLE END")


# documents -> (doc_id, t, word_count, sentence_count, flesch_reading_ease)
DOC_FEATURES = f"""
doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS (SELECT doc_id, t, {word_count('t')} AS wc, {sentence_count('t')} AS sc,
               {syllable_count('t')} AS syl FROM doc),
feat AS (SELECT doc_id, t, wc AS word_count, sc AS sentence_count,
                {flesch('wc', 'sc', 'syl')} AS flesch_reading_ease FROM raw)
"""


def quality_label(wc: str, r: str) -> str:
    return (f"CASE WHEN {wc} > 1500 AND {r} BETWEEN 50 AND 70 THEN 'High' "
            f"WHEN {wc} < 500 OR {r} < 30 THEN 'Low' ELSE 'Medium' END")


def baseline_label(wc: str) -> str:
    return f"CASE WHEN {wc} > 1500 THEN 'High' WHEN {wc} < 500 THEN 'Low' ELSE 'Medium' END"


def title(h: str) -> str:
    vis = f"regexp_replace({h}, {q(H.INVISIBLE)}, '', 'g')"
    raw = f"regexp_extract({vis}, {q(H.TITLE)}, 1)"
    return strip_outer(decode(f"regexp_replace({raw}, {q(H.TAG)}, '', 'g')"))


def paragraphs(h: str, compat: bool = False) -> str:
    vis = f"regexp_replace({h}, {q(H.INVISIBLE)}, '', 'g')"
    tag = H.TAG_GLUE if compat else H.TAG
    one = strip_outer(decode(
        f"regexp_replace(string_split_regex(x, {q(H.P_END)})[1], {q(tag)}, '', 'g')"))
    return f"list_transform(string_split_regex({vis}, {q(H.P_OPEN)})[2:], lambda x: {one})"


def body(h: str, compat: bool = False) -> str:
    return clean_ws(f"array_to_string({paragraphs(h, compat)}, ' ')")


def plain_terms(t: str) -> str:
    """X17 tokens minus the stopword list (vectorizer with stop words, no X7)."""
    return (f"list_filter(regexp_extract_all(lower({t}), {q(X.TERM)}), "
            f"lambda w: NOT list_contains({STOP_LIST}, w))")
