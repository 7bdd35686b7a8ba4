"""X8 with learnt abbreviations: counts, scores, and ends of sentences on hand-made texts."""

import math

from contentlens.operators import sentences as SENT

SCHEMA = "doc_id long, text string"
#: "Dr." always has its period; "market" ends sentences and stands within them; "Then" starts sentences only.
CORPUS = ([f"Yesterday Dr. Smith saw the market. Then he left the market and then Dr. Jones came. All was well {i}." for i in range(12)]
          + ["The market of the town is old. We went to the market with them and then home." for _ in range(6)])


def _learnt(spark):
    docs = spark.createDataFrame(list(enumerate(CORPUS)), SCHEMA)
    return SENT.sentence_types(docs).cache()


def test_types_are_counted_and_scored(spark):
    types = {r.type: r for r in _learnt(spark).collect()}
    dr, market = types["dr"], types["market"]
    assert (dr.n_period, dr.n_plain, dr.n_lower, dr.n_inside) == (24, 0, 0, 24)
    assert (market.n_period, market.n_plain) == (12, 12 + 12)
    assert dr.is_abbreviation and not market.is_abbreviation
    total = sum(r.n_period + r.n_plain for r in types.values())
    rate = sum(r.n_period for r in types.values()) / total
    assert math.isclose(dr.score, -2 * (24 * math.log(rate) - 24 * math.log(0.99)) * math.exp(-2), rel_tol=1e-9)
    assert types["then"].n_lower == 12 + 6 and types["then"].n_inside == 0


def test_an_abbreviation_ends_no_sentence(spark):
    texts = {
        1: ("Dr. Smith came. He left.", 2),
        2: ("We saw Dr. Smith", 1),
        3: ("She is the Dr. Then they left.", 2),        # a known starter follows
        4: ("Ask the Dr.", 1),                           # the last period of a text always ends it
        5: ("Prices rose by 3.14 today! Why? (So it is.) Fine", 4),
        6: ("Wait ... and see. . . .", 2),
        7: ("", 0), 8: (None, 0), 9: ("   \n ", 0),
        10: ("(see Dr.) Smith is here.", 1),
        11: ("Dr., so to say, Dr. Smith.", 1),
        12: ("word " * 20000 + "end. Last", 2),
        13: ("Bonjour ! Ca va ?", 2),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], SCHEMA)
    got = {r.doc_id: r.sentence_count for r in SENT.sentence_counts(docs, _learnt(spark)).collect()}
    assert got == {k: n for k, (_, n) in texts.items()}


def test_initials_are_abbreviations(spark):
    corpus = [(i, "The book by J. Miller is here. It is good and it is new.") for i in range(3)]
    docs = spark.createDataFrame(corpus, SCHEMA)
    types = SENT.sentence_types(docs)
    assert [r.sentence_count for r in SENT.sentence_counts(docs, types).collect()] == [2, 2, 2]


def test_empty_tables_and_shared_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert SENT.sentence_types(empty).count() == 0
    assert SENT.sentence_counts(empty, _learnt(spark)).count() == 0
    twice = spark.createDataFrame([(1, "One. Two."), (1, "Three."), (None, "Four. Five.")], SCHEMA)
    got = SENT.sentence_counts(twice, SENT.sentence_types(empty)).collect()
    assert {(r.doc_id, r.sentence_count) for r in got} == {(1, 3), (None, 2)}


def test_no_python_worker_and_words_are_counted_before_the_shuffle(spark):
    docs = spark.createDataFrame(list(enumerate(CORPUS)), SCHEMA)
    plan = SENT.sentence_counts(docs, SENT.sentence_types(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "partial_count" in plan and "CartesianProduct" not in plan
