"""X8 with learnt abbreviations: sentence ends from corpus statistics, after Kiss and Strunk (2006).

``sentence_types`` counts, in one aggregation over all words, how often each word type stands with a period, without one,
in lower case, and capitalised inside a sentence; its log-likelihood score says which types are abbreviations.
``sentence_counts`` counts the ends of each text and takes off those that are only an abbreviation's period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .holding import hold
from .stats import attach_scalars

# --- FIXED VALUES: patterns shared with the SQL twin (Java and RE2 alike) ------
CLOSERS = r"[\x22\x27)\]}\x{201D}\x{2019}\x{00BB}]*"
END = rf"[.!?]+{CLOSERS}(?:{X.WS_RUN}[.!?]+{CLOSERS})*(?:[{X.SPACES}]|\z)"
CLOSED = rf"[.!?]{CLOSERS}[{X.SPACES}]*\z"
CORE = r"^[^\p{L}\p{N}]*(.*?)[\x22\x27)\]}\x{201D}\x{2019}\x{00BB},;:]*\z"
ONE_PERIOD = r"[^.!?]\.\z"
PERIOD_END = rf"[^.!?]\.{CLOSERS}\z"
BREAK_BEFORE = rf"[.!?:]{CLOSERS}\z"
TYPE = r"^\p{L}[\p{L}.\x27\x{2019}-]*\z"
# --- FIXED VALUES: the published model's alternative hypothesis and threshold ---
ABBREVIATION_RATE = 0.99
ABBREVIATION_SCORE = 0.3


def _core(word: Column) -> Column:
    return F.regexp_extract(word, CORE, 1)


def _type(core: Column) -> Column:
    """The lower-cased word without its one final period; null for what is no word."""
    bare = F.lower(F.when(core.rlike(ONE_PERIOD), F.regexp_replace(core, r"\.\z", "")).otherwise(core))
    return F.when(bare.rlike(TYPE), bare)


def _words(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """One row a word with the word before and the word after it."""
    words = docs.select(*keep, F.regexp_extract_all(X.text_or_empty(text_col), F.lit(X.WORD), 0).alias("all"))
    n = F.size("all")
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("all", 1, F.greatest(n - 1, F.lit(0))))
    after = F.slice("all", 2, F.greatest(n - 1, F.lit(0)))
    # a text without words leaves one row without a word; a filter by their number would run the pattern twice
    return words.select(*keep, F.inline(F.arrays_zip(before.alias("before"), F.col("all").alias("word"),
                                                     after.alias("after")))).filter(F.col("word").isNotNull())


def sentence_types(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(type, n_period, n_plain, n_lower, n_inside, score, is_abbreviation), one row a word type.

    ``n_period`` and ``n_plain`` count the type with and without a final period, ``n_lower`` in lower case, ``n_inside``
    capitalised where no sentence starts.  ``score`` is the log-likelihood ratio of "always with a period" against the corpus rate,
    times exp(-letters), the number of periods, and letters ** -n_plain (never below 0).  Words are counted as spelt
    first, so the patterns run once a spelling, and partial counts before each shuffle make a hot word a row a task.  Null and empty texts have no words.
    """
    within = F.col("before").isNotNull() & ~F.col("before").rlike(BREAK_BEFORE)
    # held: the filter by type would else be pushed below this count and run its patterns at every word of every text
    spelt = hold(_words(docs, text_col).groupBy("word", within.alias("within")).agg(F.count(F.lit(1)).alias("n")))
    word = spelt.select("within", "n", _core(F.col("word")).alias("core"))
    word = word.withColumn("type", _type(F.col("core"))).filter(F.col("type").isNotNull())
    period = F.col("core").rlike(ONE_PERIOD)

    def times(which: Column) -> Column:
        return F.sum(F.when(which, F.col("n")).otherwise(0))

    types = word.groupBy("type").agg(times(period).alias("n_period"), times(~period).alias("n_plain"),
                                     times(F.col("core").rlike(r"^\p{Ll}")).alias("n_lower"),
                                     times(F.col("core").rlike(r"^\p{Lu}") & F.col("within")).alias("n_inside"))
    totals = types.agg((F.sum("n_period") / F.sum(F.col("n_period") + F.col("n_plain"))).alias("rate"))
    letters = F.length(F.replace("type", F.lit("."), F.lit(""))).cast("double")
    periods = F.length("type") - letters + 1
    with_p, plain = F.col("n_period").cast("double"), F.col("n_plain").cast("double")
    floor = F.lit(1e-300)
    ratio = -2.0 * (with_p * F.log(F.greatest(F.col("rate"), floor)) + plain * F.log(F.greatest(1.0 - F.col("rate"), floor))
                    - with_p * F.log(F.lit(ABBREVIATION_RATE)) - plain * F.log(F.lit(1.0 - ABBREVIATION_RATE)))
    weighed = ratio * F.exp(-letters) * periods * F.pow(letters, -plain)
    score = F.when((F.col("n_period") > 0) & (weighed > 0), weighed).otherwise(F.lit(0.0))
    scored = attach_scalars(types, totals).withColumn("score", score)
    # single letters are initials: their period ends a sentence only before a word that starts sentences
    initial = (F.length("type") == 1) & (F.col("n_period") > 0)
    return scored.drop("rate").withColumn("is_abbreviation", initial | (F.col("score") >= ABBREVIATION_SCORE))


def sentence_counts(docs: DataFrame, types: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_count) for every id of ``docs``; rows that share an id are summed, null and empty texts count 0.

    An end is a run of . ! ? with closing quotes or brackets before white space or the end of the text; words after the last
    end are one more sentence.  The period of an abbreviation (``types``) within a text is no end, unless the next word is
    capitalised, is known in lower case and never stands capitalised inside a sentence.
    """
    t = X.text_or_empty(text_col)
    open_tail = t.rlike(f"[^{X.SPACES}]") & ~t.rlike(CLOSED)
    ends = docs.select(F.col(id_col).alias("id"), (F.regexp_count(t, F.lit(END)) + open_tail.cast("int")).cast("long").alias("n"))
    word = (_words(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "id")
            .filter(F.col("word").rlike(PERIOD_END) & F.col("after").isNotNull() & ~F.col("after").rlike("^[.!?]")))
    word = word.withColumn("core", _core(F.col("word"))).withColumn("type", _type(F.col("core")))
    word = word.select("id", "type", _core(F.col("after")).alias("core"))
    word = word.select("id", "type", F.when(F.col("core").rlike(r"^\p{Lu}"), _type(F.col("core"))).alias("next"))
    starters = types.filter("n_lower > 0 and n_inside = 0").select(F.col("type").alias("next"))
    within = (word.join(types.filter("is_abbreviation").select("type"), "type")
              .join(starters, "next", "left_anti").select("id", F.lit(-1).cast("long").alias("n")))
    return ends.unionAll(within).groupBy("id").agg(F.sum("n").alias("sentence_count")).withColumnRenamed("id", id_col)
