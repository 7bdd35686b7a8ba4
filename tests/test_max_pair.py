"""Best-first maximum of all cosines against numpy over all pairs."""

import numpy as np
import pytest

from contentlens.operators import similarity as SIM
from contentlens.operators.max_pair import max_pair


def _frame(spark, x):
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    return SIM.as_vectors(spark.createDataFrame(rows, "id long, vec array<double>"), "id", "vec")


def _greatest(x):
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    u = x / np.where(norm > 0, norm, 1)
    return (u @ u.T)[np.triu_indices(len(u), 1)].max()


def _clusters(rng, groups, size, spread, d=16):
    centres = rng.standard_normal((groups, d))
    return (centres[:, None, :] + spread * rng.standard_normal((groups, size, d))).reshape(-1, d)


def test_clusters_need_few_products(spark):
    rng = np.random.default_rng(1)
    x = _clusters(rng, 40, 30, 0.02)
    got = max_pair(_frame(spark, x), cells=60, block=16)
    assert got.similarity == pytest.approx(_greatest(x), abs=1e-12)
    assert got.pairs == 1200 * 1199 // 2 and got.products < 0.1 * got.pairs


@pytest.mark.parametrize("case", ["random", "hot cell", "opposite", "zeros", "two", "one cell"])
def test_value_is_that_over_all_pairs(spark, case):
    rng = np.random.default_rng(2)
    x = {"random": rng.standard_normal((300, 12)),
         "hot cell": np.vstack([_clusters(rng, 1, 150, 0.3, 12), rng.standard_normal((150, 12))]),
         "opposite": np.array([[1.0, 0.0], [-1.0, 0.1]]),
         "zeros": np.array([[0.0, 0.0], [1.0, 0.0], [-1.0, 0.2]]),
         "two": np.array([[1.0, 2.0], [2.0, 1.0]]),
         "one cell": rng.standard_normal((50, 4))}[case]
    got = max_pair(_frame(spark, x), cells=1 if case == "one cell" else 12, block=20, first_share=1 / 8)
    assert got.similarity == pytest.approx(_greatest(x), abs=1e-9)
    assert got.products <= got.pairs


def test_fewer_than_two_rows_have_no_maximum(spark):
    assert max_pair(_frame(spark, np.array([[1.0, 2.0]]))).similarity is None
    none = spark.createDataFrame([], "id long, vec array<double>")
    assert max_pair(SIM.as_vectors(none, "id", "vec")).similarity is None
    one = SIM.upper_triangle_stats(_frame(spark, np.array([[1.0, 2.0]]))).first()
    assert (one.n_pairs, one.max_similarity) == (0, None)


def test_copies_of_zero_vectors_and_of_others(spark):
    st = SIM.upper_triangle_stats(_frame(spark, np.array([[0.0, 0.0], [0.0, 0.0], [1.0, 0.0], [-1.0, 0.0]]))).first()
    assert (st.n_pairs, st.max_similarity) == (6, 0.0)
    assert SIM.upper_triangle_stats(_frame(spark, np.array([[0.0, 0.0], [0.0, 0.0]]))).first().max_similarity == 0.0
    assert SIM.upper_triangle_stats(_frame(spark, np.array([[1.0, 3.0], [1.0, 3.0]]))).first().max_similarity == 1.0
