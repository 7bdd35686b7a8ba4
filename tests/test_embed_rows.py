"""T14 within rows against its long form, and the types of entities without a hot key."""

import numpy as np
import pytest

from contentlens.operators import embed as EM
from contentlens.operators import entities as ENT

TEXTS = ["alpha beta beta gamma", "gamma beta alpha beta", "", None, "the of and", "alpha delta epsilon zeta zeta",
         "omega unique1 unique2 alpha", "beta beta beta", "émile ñandú été alpha"] + [f"word{i % 7} word{i} alpha" for i in range(40)]


@pytest.mark.parametrize("known", [200_000, 3, 0])
def test_rows_give_the_vectors_of_the_long_form(spark, monkeypatch, known):
    monkeypatch.setattr(EM, "KNOWN", known)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    tf = EM._tf(docs, "doc_id", "text")
    df, n = EM.fit_idf(docs, tf=tf)
    want = {r.doc_id: r for r in EM._encode_tf(docs, tf, df, n, "doc_id", 16).collect()}
    vectors, term_df, total = EM.fit(docs, dim=16)
    got = {r.doc_id: r for r in vectors.collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert r.indices == want[i].indices and np.allclose(r["values"], want[i]["values"], rtol=0, atol=1e-7)
    assert got[0]["values"] == got[1]["values"]
    new = spark.createDataFrame([(1, "alpha neverseen"), (2, "")], "k long, text string")
    a = {r.k: r for r in EM.encode(new, term_df, total, "k", dim=16).collect()}
    b = {r.k: r for r in EM._encode_tf(new, EM._tf(new, "k", "text"), df, n, "k", 16).collect()}
    assert all(a[k].indices == b[k].indices and np.allclose(a[k]["values"], b[k]["values"], rtol=0, atol=1e-7) for k in b)


def test_terms_are_not_shuffled_with_their_document(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    plan = EM.fit(docs)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [doc#" not in plan or "term#" not in plan.split("Aggregate [doc#")[1].split("]")[0]


def test_rows_that_share_an_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "beta gamma"), (2, "alpha"), (None, "alpha delta")], "doc_id long, text string")
    rows = [(r.doc_id, tuple(r.indices)) for r in EM.hashed_tfidf(docs).collect()]
    assert len(rows) == 4 and len(rows[[r[0] for r in rows].index(1)][1]) == 3
    assert next(r for r in rows if r[0] is None)[1] == ()


def test_types_are_joined_once_a_spelling(spark):
    docs = spark.createDataFrame([(i, "We met Anna here. Yesterday Anna Smith spoke. Paris is far.") for i in range(50)], "doc_id long, text string")
    gaz = spark.createDataFrame([("Anna", "PERSON"), ("Smith", "X"), ("Anna Smith", "PERSON"), ("Paris", "PLACE")], "phrase string, type string")
    ents = ENT.extract_entities(docs, gazetteer=gaz)
    plan = ents._jdf.queryExecution().optimizedPlan().toString()
    assert "(tail#" not in plan.split("Join")[1]  # the last join is by spelling, not by a mostly null tail
    kinds = {(r.entity, r.type) for r in ents.collect()}
    assert ("Anna", "PERSON") in kinds and ("Anna Smith", "PERSON") in kinds and ("Paris", "PLACE") in kinds
    assert ents.count() % 50 == 0
