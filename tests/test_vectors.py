"""Vector fixtures (FIXTURES.md section 6) and brute-force checks of the pair search."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentlens.functions import vectors as V
from contentlens.operators import similarity as SIM

ROWS = [(1, "A", [1.0, 0.0]), (2, "B", [1.0, 0.0]), (3, "C", [4.0, 3.0]), (4, "D", [0.0, 1.0]),
        (5, "Z", [0.0, 0.0]), (6, "E", None)]


@pytest.fixture(scope="module")
def vecs(spark):
    df = spark.createDataFrame(ROWS, "id long, url string, vec array<float>")
    return df


def flat_pairs(pairs, groups, members):
    """Expand the compact form to the reference's flat pair list (test-only, brute force)."""
    by_rep = {}
    for rep, i in members:
        by_rep.setdefault(rep, []).append(i)
    out = set()
    for g in groups:
        ids = sorted(by_rep.get(g.rep, [g.rep]))
        out |= {(a, b, 1.0) for a, b in itertools.combinations(ids, 2)}
    for p in pairs:
        for a in by_rep.get(p.id_1, [p.id_1]):
            for b in by_rep.get(p.id_2, [p.id_2]):
                out.add((min(a, b), max(a, b), round(p.similarity, 4)))
    return out


def brute(rows, t, empty_match=True):
    out = set()
    valid = [(i, np.asarray(v, float)) for i, _, v in rows if v is not None]
    for (i, a), (j, b) in itertools.combinations(valid, 2):
        na, nb = np.linalg.norm(a), np.linalg.norm(b)
        if na == 0 and nb == 0:
            s = 1.0 if empty_match else 0.0
        elif na == 0 or nb == 0:
            s = 0.0
        else:
            s = float(a @ b / (na * nb))
        if s > t:
            out.add((min(i, j), max(i, j), round(s, 4)))
    return out


def run_j3(spark, df, t, policy="match"):
    v = SIM.as_vectors(df, "id", "vec")
    pairs, groups = SIM.duplicate_pairs(v, t, empty_policy=policy, block_size=2)
    members = [(r.rep, r.id) for r in SIM.copy_members(v, groups).collect()]
    return pairs, groups, members


def test_cosine_column(spark, vecs):
    a = vecs.alias("a").join(vecs.alias("b"), F.col("a.id") < F.col("b.id")).filter(
        F.col("a.vec").isNotNull() & F.col("b.vec").isNotNull())
    got = {(r.i, r.j): r.s for r in a.select(F.col("a.url").alias("i"), F.col("b.url").alias("j"),
                                             V.cosine_similarity("a.vec", "b.vec").alias("s")).collect()}
    assert got[("A", "B")] == pytest.approx(1.0)
    assert got[("A", "C")] == pytest.approx(0.8)
    assert got[("C", "D")] == pytest.approx(0.6)
    assert got[("A", "D")] == pytest.approx(0.0)
    assert got[("A", "Z")] == 0.0


@pytest.mark.parametrize("t", [0.80, 0.75, 0.5, 0.0])
def test_duplicate_pairs_match_brute_force(spark, vecs, t):
    pairs, groups, members = run_j3(spark, vecs, t)
    got = flat_pairs(pairs.collect(), groups.collect(), members)
    assert got == brute(ROWS, t)
    n = SIM.pair_count(pairs, groups).first().duplicate_pairs
    assert n == len(got)


def test_fixture_thresholds(spark, vecs):
    pairs, groups, _ = run_j3(spark, vecs, 0.80)
    assert pairs.count() == 0 and [(g.rep, g.copies) for g in groups.collect()] == [(1, 2)]
    pairs, groups, _ = run_j3(spark, vecs, 0.75)
    assert {(p.id_1, p.id_2, round(p.similarity, 4), p.copies_1) for p in pairs.collect()} == {(1, 3, 0.8, 2)}


def test_empty_policy_and_no_pairs(spark):
    rows = [(1, "a", [0.0, 0.0]), (2, "b", [0.0, 0.0]), (3, "c", [0.0, 0.0]), (4, "d", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, url string, vec array<float>")
    pairs, groups, _ = run_j3(spark, df, 0.8, "match")
    assert SIM.pair_count(pairs, groups).first().duplicate_pairs == 3
    pairs, groups, _ = run_j3(spark, df, 0.8, "drop")
    assert SIM.pair_count(pairs, groups).first().duplicate_pairs == 0
    assert pairs.columns == ["id_1", "id_2", "similarity", "copies_1", "copies_2"]


def test_random_copies_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 6))
    rows = []
    for i in range(40):
        v = base[i % 12] if i % 3 else base[i % 12] + rng.normal(scale=0.3, size=6)
        rows.append((i, f"u{i}", [float(x) for x in v.astype(np.float32)]))
    df = spark.createDataFrame(rows, "id long, url string, vec array<float>")
    for t in (0.5, 0.9):
        pairs, groups, members = run_j3(spark, df, t)
        got = flat_pairs(pairs.collect(), groups.collect(), members)
        want = brute([(i, u, np.asarray(v, np.float32)) for i, u, v in rows], t)
        assert {(a, b) for a, b, _ in got} == {(a, b) for a, b, _ in want}


def test_similar_pages(spark, vecs):
    v = SIM.as_vectors(vecs, "id", "vec")
    q = SIM.as_vectors(spark.createDataFrame([(100, [1.0, 0.0])], "id long, vec array<float>"), "id", "vec")
    r = SIM.similar_pages(q, v, k=5, threshold=0.80, block_size=2).orderBy("rank").collect()
    assert [(x.id, round(x.similarity, 4)) for x in r] == [(1, 1.0), (2, 1.0), (3, 0.8)]
    r = SIM.similar_pages(q, v, k=2, threshold=0.70, block_size=2).orderBy("rank").collect()
    assert [x.id for x in r] == [1, 2]


def test_upper_triangle_and_rounding(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [4.0, 3.0]), (4, [0.0, 1.0])]
    v = SIM.as_vectors(spark.createDataFrame(rows, "id long, vec array<float>"), "id", "vec")
    st = SIM.upper_triangle_stats(v, block_size=2).first()
    assert st.n_pairs == 6 and st.mean_similarity == pytest.approx(3.2 / 6) and st.max_similarity == pytest.approx(1.0)
    m = SIM.similarity_matrix(SIM.as_vectors(spark.createDataFrame([(1, [3.0, 1.0]), (2, [1.0, 0.0])],
                                                                   "id long, vec array<float>"), "id", "vec"))
    assert round(m.first().similarity, 4) == 0.9487


def test_same_url_rows_are_separate(spark):
    df = spark.createDataFrame([(1, "u", [1.0, 2.0]), (2, "u", [1.0, 2.0])], "id long, url string, vec array<float>")
    pairs, groups, _ = run_j3(spark, df, 0.8)
    assert SIM.pair_count(pairs, groups).first().duplicate_pairs == 1


class _Lengths:
    def encode(self, texts, batch_size=32):
        return [[float(len(t)), 1.0] for t in texts]


def test_pluggable_encoder(spark):
    from contentlens.operators import embed as EM
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.embedding for r in EM.encode_with(docs, _Lengths, dim=2).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0]}


def test_copies_rank_by_id_and_self_is_left_out(spark):
    rows = [(i, [1.0, 2.0]) for i in range(6)] + [(9, [2.0, -1.0])]
    v = SIM.as_vectors(spark.createDataFrame(rows, "id long, vec array<float>"), "id", "vec")
    got = SIM.similar_pages(v.filter("id in (0, 9)"), v, k=3, threshold=0.7, block_size=2, exclude_self=True).orderBy("rank").collect()
    assert [(r.qid, r.id, r.rank) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]


def test_parse_embedding(spark):
    rows = [("[1.0, 2.5,-3]",), ("[1,\n 2]",), ("1,2",), ("[1,b]",), ("[]",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    got = [r.v for r in df.select(V.parse_embedding("s").alias("v")).collect()]
    assert got[0] == [1.0, 2.5, -3.0] and got[1] == [1.0, 2.0] and got[2] == [1.0, 2.0]
    assert got[3:] == [None, None, None]


def test_hashed_encoder_copies_identical(spark):
    from contentlens.operators import embed as EM
    docs = spark.createDataFrame([(1, "alpha beta gamma beta"), (2, "alpha beta gamma beta"),
                                  (3, "delta epsilon"), (4, "")], "doc_id long, text string")
    v = {r.doc_id: r for r in EM.hashed_tfidf(docs).collect()}
    assert v[1].indices == v[2].indices and v[1].values == v[2].values
    assert v[4].indices == [] and v[4].values == []
    assert sum(x * x for x in v[3].values) == pytest.approx(1.0, rel=1e-6)


