"""Named entities, re-aimed from a trained chunker to a native rule.

Candidates are runs of capitalised words (``regexp_extract_all``); leading
stopwords ("The", "In") are dropped from a run.  The type comes from a
gazetteer (broadcast join; seed table or a user table) matched on the run,
or on the run without its first word, else ``UNKNOWN``.
Everything stays in the JVM; the gazetteer is the only resource.

``gazetteer_matches`` finds the phrases of a table of any size at every position, whatever their case.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.resources import ENGLISH_STOPWORDS, SEED_GAZETTEER
from .holding import hold
from .stats import top_k

# --- FIXED VALUES: candidate pattern and minimum text length -----------------
CAPITALISED_RUN = r"\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+)*"
# Same matches, but the possessive loop runs without recursion in the JVM, so a
# run of any length (a list page in title case) cannot exhaust the stack.
RUN_PATTERN = CAPITALISED_RUN + "+"
NGRAM_WORD = r"[\p{L}\p{N}]+"
MIN_CHARS = 10
UNKNOWN = "UNKNOWN"


def entity_candidates(text) -> F.Column:
    """Array of entity strings of one text, in order of appearance."""
    runs = F.regexp_extract_all(X.text_or_empty(text), F.lit(RUN_PATTERN), 0)

    def trim_lead(run):
        words = F.split(run, " ")
        first = F.array_position(F.transform(words, lambda w: F.lower(w).isin(ENGLISH_STOPWORDS)), False)
        return F.when(first > 0, F.array_join(F.slice(words, first.cast("int"), F.size(words)), " "))

    return F.filter(F.transform(runs, trim_lead), lambda e: e.isNotNull())


def extract_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     gazetteer: DataFrame | None = None) -> DataFrame:
    """(id, idx, entity, type) rows; texts shorter than 10 characters give none."""
    spark = docs.sparkSession
    gaz = gazetteer if gazetteer is not None else spark.createDataFrame(SEED_GAZETTEER, "phrase string, type string")
    gaz = gaz.groupBy("phrase").agg(F.min("type").alias("type"))
    if gazetteer is None:  # the built-in list; a user's table is joined as its size allows
        gaz = F.broadcast(gaz)
    t = X.text_or_empty(text_col)
    ents = docs.filter(F.length(t) >= MIN_CHARS).select(
        F.col(id_col), F.posexplode(entity_candidates(text_col)).alias("idx", "entity"))
    # A run that starts a sentence carries that capitalised first word
    # ("Yesterday John Smith"): when only the run minus its first word is
    # a known phrase, that suffix is the entity.
    words = F.split("entity", " ")
    ents = ents.withColumn("tail", F.when(F.size(words) >= 2,
                                          F.array_join(F.slice(words, 2, F.size(words)), " ")))
    g1 = gaz.select(F.col("phrase").alias("entity"), F.col("type").alias("t1"))
    g2 = gaz.select(F.col("phrase").alias("tail"), F.col("type").alias("t2"))
    if gazetteer is None:
        typed = ents.join(g1, "entity", "left").join(g2, "tail", "left")
    else:
        # Types are found once a spelling (one row a map task, however often it stands), and only
        # spellings with a tail are joined by it: a null tail is no key.
        kinds = ents.select("entity", "tail").distinct().join(g1, "entity", "left")
        tails = kinds.filter("tail IS NOT NULL").select("entity", "tail").join(g2, "tail").select("entity", "t2")
        kinds = kinds.join(tails, "entity", "left").filter("t1 IS NOT NULL OR t2 IS NOT NULL")
        typed = ents.join(kinds.select("entity", "t1", "t2"), "entity", "left")
    use_tail = F.col("t1").isNull() & F.col("t2").isNotNull()
    return typed.select(id_col, "idx", F.when(use_tail, F.col("tail")).otherwise(F.col("entity")).alias("entity"),
                        F.coalesce("t1", "t2", F.lit(UNKNOWN)).alias("type"))


def gazetteer_matches(docs: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      max_words: int = 3) -> DataFrame:
    """(id, start, n_words, phrase, type): phrases of ``gazetteer`` (phrase, type) in the texts, in any case and within any run.

    Words are runs of letters and digits; the 1- to ``max_words``-grams at every position are joined to the phrases, and of what
    overlaps the leftmost, then the longest is taken.  A phrase of several types has the smallest."""
    word = F.lit(NGRAM_WORD)

    def words_of(column):
        return F.regexp_extract_all(F.lower(X.text_or_empty(column)), word, 0)

    phrases = gazetteer.select(F.array_join(words_of("phrase"), " ").alias("phrase"), "type").filter("phrase <> ''")
    phrases = phrases.groupBy("phrase").agg(F.min("type").alias("type"))
    words = docs.select(F.col(id_col).alias("id"), words_of(text_col).alias("words"))
    # the word at every position with those after it: a row a position, without its text
    n = F.size("words")
    row = [F.slice("words", F.lit(k + 1), F.greatest(n - k, F.lit(0))).alias(f"w{k}") for k in range(max_words)]
    at = words.select("id", F.posexplode(F.arrays_zip(*row)).alias("start", "w"))
    gram = [F.col("w.w0")]
    for k in range(1, max_words):
        gram.append(F.concat(gram[-1], F.lit(" "), F.col(f"w.w{k}")))  # null where the text ends
    grams = at.select("id", "start", F.posexplode(F.array(*gram)).alias("more", "phrase"))
    found = grams.join(phrases, "phrase").select("id", F.struct(
        "start", (-F.col("more") - 1).alias("minus_n"), "phrase", "type").alias("m"))
    # one text's matches in page order; a text is one row, so the list is bounded by its words
    ordered = found.groupBy("id").agg(F.sort_array(F.collect_list("m")).alias("all")).select(
        "id", F.col("all.start").alias("start"), F.col("all.minus_n").alias("minus_n"), "all")
    kind = ordered.schema["id"].dataType.simpleString()
    item = ordered.schema["all"].dataType.simpleString()
    taken = ordered.mapInArrow(_leftmost, f"id {kind}, taken {item}")
    return taken.select(F.col("id").alias(id_col), F.inline("taken")).select(
        id_col, "start", (-F.col("minus_n")).alias("n_words"), "phrase", "type")


def _leftmost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row's matches, in order of start and length, those that begin where none taken before reaches."""
    for batch in batches:
        matches = batch.column(3)
        starts, minus = batch.column(1).flatten().to_pylist(), batch.column(2).flatten().to_pylist()
        kept, ends, at = [], [0], 0
        for size in matches.value_lengths().to_pylist():
            end = 0
            for k in range(at, at + size):
                if starts[k] >= end:
                    end = starts[k] - minus[k]
                    kept.append(k)
            at += size
            ends.append(len(kept))
        taken = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), matches.flatten().take(pa.array(kept, pa.int64())))
        yield pa.RecordBatch.from_arrays([batch.column(0), taken], ["id", "taken"])


def entities_with_gazetteer(docs: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            max_words: int = 3) -> DataFrame:
    """(id, entity, type, n): typed phrases of each text with their places counted, and the capitalised runs that hold none of them."""
    typed = hold(gazetteer_matches(docs, gazetteer, id_col, text_col, max_words))  # read by both branches
    typed = typed.groupBy(id_col, F.col("phrase").alias("entity"), "type").agg(F.count(F.lit(1)).alias("n"))
    known = typed.groupBy(id_col).agg(F.collect_set(F.concat(F.lit(" "), "entity", F.lit(" "))).alias("known"))
    runs = docs.select(F.col(id_col), F.explode(entity_candidates(text_col)).alias("entity"))
    runs = runs.groupBy(id_col, "entity").agg(F.count(F.lit(1)).alias("n")).join(known, id_col, "left")
    plain = F.concat(F.lit(" "), F.lower("entity"), F.lit(" "))
    holds = F.exists("known", lambda p: F.contains(plain, p))
    rest = runs.filter(F.col("known").isNull() | ~holds).select(id_col, "entity", F.lit(UNKNOWN).alias("type"), "n")
    return typed.unionByName(rest).groupBy(id_col, "entity", "type").agg(F.sum("n").alias("n"))


def top_entity_types(entities: DataFrame, n: int = 10) -> DataFrame:
    """Most common types (ties by type)."""
    c = entities.groupBy("type").agg(F.count(F.lit(1)).cast("long").alias("n"))
    return top_k(c, "n", n, "type")


def top_entities(entities: DataFrame, n: int = 15) -> DataFrame:
    """Most common entity strings (ties by entity)."""
    c = entities.groupBy("entity").agg(F.count(F.lit(1)).cast("long").alias("n"))
    return top_k(c, "n", n, "entity")

