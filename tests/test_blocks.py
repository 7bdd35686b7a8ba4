"""Packed blocks against numpy over all pairs; no vector is sent once a block."""

import numpy as np
import pytest

from contentlens.operators import blocks
from contentlens.operators import similarity as SIM


def _vectors(spark, n=400, d=12, seed=3):
    rng = np.random.default_rng(seed)
    x = np.abs(rng.standard_normal((n, d))) * (rng.random((n, d)) < 0.6)
    x[7], x[11] = 0, x[10]
    rows = [(3 * i, [k for k in range(d) if r[k]], [float(c) for c in r if c]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, at array<int>, w array<double>")
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    u = x / np.where(norm > 0, norm, 1)
    return SIM.as_vectors(df, "k", sparse=("at", "w")), u @ u.T


def _shuffled_generates(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Generate explode")


@pytest.mark.parametrize("block", [2048, 90, 1])
def test_block_pairs_are_all_pairs(spark, block):
    v, s = _vectors(spark, 60 if block == 1 else 400)
    i, j = np.nonzero(np.triu(s > 0.8, 1))
    got = SIM.block_pairs(v, 0.8, block)
    assert _shuffled_generates(got) == 0  # rows were copied to every block before
    found = {(r.id_1, r.id_2): r.similarity for r in got.collect()}
    assert set(found) == set(zip((3 * i).tolist(), (3 * j).tolist())) and len(found) == got.count()
    assert all(abs(found[p] - s[p[0] // 3, p[1] // 3]) < 1e-12 for p in found)


def test_similar_pages_of_many_blocks(spark):
    v, s = _vectors(spark)
    got = SIM.similar_pages(v.filter("id % 5 = 0"), v, 3, 0.7, block_size=40, exclude_self=True)
    assert _shuffled_generates(got) == 0
    s = np.round(s, 9)
    np.fill_diagonal(s, -1)
    want = {(3 * q, r + 1, 3 * int(c)) for q in range(len(s)) if 3 * q % 5 == 0
            for r, c in enumerate(np.lexsort((np.arange(len(s)), -s[q]))[:3]) if s[q, c] >= 0.7}
    assert {(r.qid, r["rank"], r.id) for r in got.collect()} == want


def test_copies_go_along(spark):
    v, _ = _vectors(spark)
    both = v.unionByName(v.filter("id < 90").withColumn("id", v.id + 100_000))
    pairs, _ = SIM.duplicate_pairs(both, 0.8, block_size=64)
    n = {r.rep: r.copies for r in SIM.collapse_copies(both).collect()}
    rows = pairs.collect()
    assert rows and all((r.copies_1, r.copies_2) == (n[r.id_1], n[r.id_2]) for r in rows)
    assert any(r.copies_1 > 1 for r in rows) and any(r.copies_2 == 1 for r in rows)


def test_single_precision_loses_no_pair():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 384))
    x[150:] = x[:150] + 0.75 * rng.standard_normal((150, 384))
    a = blocks.load(blocks._packed(np.arange(300), x, np.float64, {}))
    s = a.unit @ a.unit.T
    for t in np.sort(s[np.arange(150), np.arange(150) + 150])[::10]:  # thresholds that some pair meets exactly
        i, j, _ = blocks.close_pairs(a, a, t - 1e-13)
        assert set(zip(*np.nonzero(s >= t))) <= set(zip(i, j))


def test_cells_and_maximum_copy_no_vector_to_its_partners(spark):
    from contentlens.operators import cells, max_pair
    import inspect
    v, s = _vectors(spark)
    got, _ = cells.search_cells(v.filter("id % 5 = 0"), cells.build_cells(v, 9), 3, 0.7, exclude_self=True, block=40)
    assert _shuffled_generates(got) == 0  # a query was copied to every cell it visits before
    want = SIM.similar_pages(v.filter("id % 5 = 0"), v, 3, 0.7, exclude_self=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    np.fill_diagonal(s, -1)
    assert abs(max_pair.max_pair(v, cells=9, block=40).similarity - s.max()) < 1e-12
    assert "explode" not in inspect.getsource(max_pair)
