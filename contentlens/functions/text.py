"""Text scalar functions as native Column expressions (no Python UDFs).

All of these run inside whole-stage code generation or as plain Catalyst
expressions, so they scale with the executors and never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .resources import ENGLISH_STOPWORDS, VOWELS

# --- FIXED VALUES: regular expressions shared with the SQL oracle ---------
# White space as Python's str methods know it (Unicode), spelt for Java and RE2 alike.
SPACES = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WS_RUN = f"[{SPACES}]+"
WORD = f"[^{SPACES}]+"
OUTER = f"^{WS_RUN}|{WS_RUN}$"
SENTENCE = f"[^.!?{SPACES}][^.!?]*[.!?]*"
TERM = r"[\p{L}\p{N}_]{2,}"
VOWEL_GROUP = f"[{VOWELS}]+"
VOWELLESS_TOKEN = rf"(?<![^{SPACES}])[^{SPACES}{VOWELS}]+(?![^{SPACES}])"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c) -> Column:
    """S2 / X6 null rule: null (or non-string) text becomes ''."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def strip_outer(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of any kind."""
    return F.regexp_replace(_col(c), OUTER, "")


def clean_whitespace(c) -> Column:
    """Runs of whitespace become one space; trimmed."""
    return F.trim(F.regexp_replace(_col(c), WS_RUN, " "))


def preprocess_text(c) -> Column:
    """Null -> '', lowercase, X4."""
    return clean_whitespace(F.lower(text_or_empty(c)))


def word_count(c) -> Column:
    """Number of whitespace-separated tokens, 0 for empty/null."""
    return F.regexp_count(text_or_empty(c), F.lit(WORD)).cast("long")


def sentence_count(c) -> Column:
    """Runs ending in . ! ? (or end of text) that start with a visible character."""
    return F.regexp_count(text_or_empty(c), F.lit(SENTENCE)).cast("long")


def syllable_count(c) -> Column:
    """Per token max(1, vowel groups), summed over tokens.

    Computed without splitting: total vowel groups plus the number of tokens
    that have none (vowel groups never span whitespace).
    """
    low = F.lower(text_or_empty(c))
    return (F.regexp_count(low, F.lit(VOWEL_GROUP))
            + F.regexp_count(low, F.lit(VOWELLESS_TOKEN))).cast("long")


def flesch_reading_ease(words, sentences, syllables) -> Column:
    """206.835 - 1.015 W/S - 84.6 Syl/W, rounded to 2; 0.0 without words.

    A text with words but no sentence terminator-run counts as one sentence.
    """
    w = _col(words).cast("double")
    s = F.greatest(_col(sentences), F.lit(1)).cast("double")
    syl = _col(syllables).cast("double")
    score = F.lit(206.835) - F.lit(1.015) * (w / s) - F.lit(84.6) * (syl / F.greatest(w, F.lit(1.0)))
    return F.when(_col(words) > 0, F.round(score, 2)).otherwise(F.lit(0.0))


def text_features(c) -> Column:
    """X11: struct(word_count, sentence_count, flesch_reading_ease)."""
    t = text_or_empty(c)
    wc, sc, syl = word_count(t), sentence_count(t), syllable_count(t)
    return F.struct(
        wc.alias("word_count"),
        sc.alias("sentence_count"),
        flesch_reading_ease(wc, sc, syl).alias("flesch_reading_ease"),
    )


def remove_stopwords(c, stopwords=None) -> Column:
    """Drop whitespace tokens found in the list (exact match), rejoin with ' '.

    The membership test is an ``IN`` over literals, which Catalyst turns into a
    hash-set lookup (``InSet``).
    """
    words = list(ENGLISH_STOPWORDS if stopwords is None else stopwords)
    toks = F.split(_col(c), " ")
    if not words:
        return F.array_join(F.filter(toks, lambda w: w != ""), " ")
    return F.array_join(F.filter(toks, lambda w: (w != "") & ~w.isin(words)), " ")


def tokenize_terms(c) -> Column:
    """Lowercase word tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(TERM), 0)


def drop_stop_terms(tokens, stopwords=None) -> Column:
    words = list(ENGLISH_STOPWORDS if stopwords is None else stopwords)
    if not words:
        return _col(tokens)
    return F.filter(_col(tokens), lambda t: ~t.isin(words))


def keyword_terms(c, stopwords=None) -> Column:
    """Terms of the keyword extractor: X6, X7, then X17 and the list again."""
    kept = remove_stopwords(preprocess_text(c), stopwords)
    return drop_stop_terms(F.regexp_extract_all(kept, F.lit(TERM), 0), stopwords)


def ngrams_1_2(tokens) -> Column:
    """Unigrams followed by bigrams of consecutive tokens.

    Pass a column *reference* (materialise the tokens in an earlier
    projection): the array is read three times here.
    """
    t = _col(tokens)
    n = F.size(t)
    bigrams = F.zip_with(F.slice(t, 1, F.greatest(n - 1, F.lit(0))),
                         F.slice(t, 2, F.greatest(n - 1, F.lit(0))),
                         lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n >= 2, F.concat(t, bigrams)).otherwise(t)


def truncate_text(c, n: int) -> Column:
    """First ``n`` characters."""
    return F.substring(text_or_empty(c), 1, n)


def body_preview(c, n: int = 500) -> Column:
    """First 500 characters, '' for empty."""
    return F.substring(text_or_empty(c), 1, n)
