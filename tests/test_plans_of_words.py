"""What is done once a word, once a spelling and once a text; the same rows as the plain forms."""

import re

from pyspark.sql import functions as F

from contentlens.operators import entities as ENT
from contentlens.operators import sentences as S
from contentlens.operators import tfidf as T


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_types_are_found_once_a_spelling(spark):
    docs = spark.createDataFrame([(1, "Dr. Who met Mr. X. He left."), (2, None), (3, ""), (4, " ")], "doc_id long, text string")
    types = S.sentence_types(docs)
    lines = plan_of(types).splitlines()
    over = [lines[k - 1] for k, line in enumerate(lines) if "Generate inline" in line]
    assert over and not any("regexp_" in line for line in over)  # no pattern runs at every word but that of its neighbour
    assert {r["type"]: (r["n_period"], r["n_plain"]) for r in types.collect()} == {
        "dr": (1, 0), "who": (0, 1), "met": (0, 1), "mr": (1, 0), "x": (1, 0), "he": (0, 1), "left": (1, 0)}


def test_texts_without_words_have_no_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "a b")], "doc_id long, text string")
    rows = [tuple(r) for r in S._words(docs, "text", "doc_id").collect()]
    assert rows == [(4, None, "a", "b"), (4, "a", "b", None)]
    assert plan_of(S._words(docs, "text", "doc_id")).count("regexp_extract_all") == 1


def test_a_position_does_not_carry_its_text(spark):
    docs = spark.createDataFrame([(1, "New York city, new york New"), (2, None), (3, "York"), (None, "york new york")], "doc_id long, text string")
    gaz = spark.createDataFrame([("new york", "B"), ("new york", "A"), ("york", "C"), ("york city", "D"), ("new york new", "E"), (" ", "F")], "phrase string, type string")
    found = ENT.gazetteer_matches(docs, gaz)
    places = [line for line in plan_of(found).splitlines() if "Generate posexplode(arrays_zip" in line]
    assert places and not re.search(r"words#\d+, start", "".join(places))
    assert "lambdafunction" not in plan_of(found)  # matches are chosen in one pass, not by copying a growing list
    assert sorted(found.collect(), key=str) == sorted([
        (1, 0, 2, "new york", "A"), (1, 3, 3, "new york new", "E"), (3, 0, 1, "york", "C"),
        (None, 0, 1, "york", "C"), (None, 1, 2, "new york", "A")], key=str)


def test_of_overlapping_phrases_the_leftmost_longest(spark):
    text = " ".join(["a b c"] * 50)
    docs = spark.createDataFrame([(1, text), (2, "b c a b")], "doc_id long, text string")
    gaz = spark.createDataFrame([("a b", "1"), ("b c", "2"), ("c a b", "3"), ("c", "4")], "phrase string, type string")
    got = ENT.gazetteer_matches(docs, gaz).groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in got.collect()} == {(1, "a b", 1), (1, "c a b", 49), (1, "c", 1), (2, "b c", 1), (2, "a b", 1)}
    both = ENT.entities_with_gazetteer(spark.createDataFrame([(1, "The Big A B and Bob saw Bob")], "doc_id long, text string"), gaz)
    assert {tuple(r) for r in both.collect()} == {(1, "a b", "1", 1), (1, "Big", "UNKNOWN", 1), (1, "Bob", "UNKNOWN", 2)}


def test_terms_are_sorted_natively(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, "a")], "doc_id long, text string")
    stats, _ = T._counted(docs, "doc_id", F.split("text", " "), True)
    assert "array_sort(" not in plan_of(stats).replace("sort_array(", "")
    assert {tuple(r) for r in stats.collect()} == {("a", 2, 2), ("b", 2, 1)}
