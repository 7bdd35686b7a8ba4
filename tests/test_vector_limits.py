"""Pair sums formed in the tasks, bounded slices of memory, and whole query sets of J4 and J8."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentlens.operators import blocks, candidates, cells
from contentlens.operators import similarity as SIM
from contentlens.operators import stats as S
from contentlens.operators.max_pair import max_pair
from contentlens.plans import queries_vectors as QV


def _rows(n=400, d=12, seed=3):
    rng = np.random.default_rng(seed)
    x = np.abs(rng.standard_normal((n, d)))
    x[7], x[9], x[11], x[12] = 0, 0, x[10], x[10]
    return x


def _frame(spark, x):
    return SIM.as_vectors(spark.createDataFrame([(3 * i, r.tolist()) for i, r in enumerate(x)], "k long, x array<double>"), "k", "x")


def _cosines(x):
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    u = x / np.where(norm > 0, norm, 1)
    return u @ u.T


@pytest.mark.parametrize("copies, block", [(True, 40), (False, 40), (True, 2048)])
def test_histogram_of_pairs_from_bins(spark, copies, block):
    x = _rows()
    x = x if copies else np.unique(x[13:], axis=0)
    v = _frame(spark, x)
    pairs, groups = SIM.duplicate_pairs(v, 0.8, block_size=block)
    binned, again = SIM.duplicate_pairs(v, 0.8, block_size=block, bins=20)

    def counts(p, g, w):
        of = g.select("similarity", (F.col("copies") * (F.col("copies") - 1) / 2).cast("long").alias("w"))
        return [tuple(r) for r in S.histogram(p.select("similarity", w.alias("w")).unionByName(of), "similarity", 20, weight_col="w").orderBy("bin").collect()]

    want = counts(pairs, groups, F.col("copies_1") * F.col("copies_2"))
    assert counts(binned, again, F.col("pairs")) == want and sum(r[-1] for r in want) > 1000
    if block == 2048 and copies:
        assert binned.count() < 0.2 * pairs.count()


@pytest.mark.parametrize("block", [40, 2048])
def test_totals_of_pairs(spark, block):
    v = _frame(spark, _rows())
    pairs, groups = SIM.duplicate_pairs(v, 0.8, block_size=block)
    totals, again = SIM.duplicate_pairs(v, 0.8, block_size=block, totals=True)
    assert SIM.pair_count(totals, again).first() == SIM.pair_count(pairs, groups).first()
    rows = pairs.collect()
    assert {r.rep for r in totals.collect()} == {i for r in rows for i in (r.id_1, r.id_2)}
    by_rep = {}
    for r in rows:
        by_rep[r.id_1] = by_rep.get(r.id_1, 0) + r.copies_1 * r.copies_2
    got = {r.rep: r.n for r in totals.groupBy("rep").agg(F.sum("pairs").alias("n")).collect()}
    assert {k: n for k, n in got.items() if n} == by_rep


def test_past_pairs_at_thresholds_that_pairs_meet():
    x = np.random.default_rng(4).standard_normal((300, 64))
    a = blocks.load(blocks._packed(np.arange(300), x, np.float64, {}))
    s = np.concatenate([blocks.cosines(a, a, np.full(300, i), np.arange(300)) for i in range(300)]).reshape(300, 300)
    for t in (float(s[3, 4]), float(s[10, 250]), 0.25):
        i, j = blocks.past_pairs(a, a, t)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(s > t))))


def _peak(f):
    tracemalloc.start()
    f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_centres_are_fitted_in_slices():
    u = np.random.default_rng(1).standard_normal((8000, 8))
    u /= np.linalg.norm(u, axis=1)[:, None]
    assert _peak(lambda: cells.fit_centres(u, 2000)) < 40  # the whole product has 128 MB


def test_visits_take_one_bit_a_cell(spark):
    v = _frame(spark, _rows())
    index = cells.build_cells(v, 300)
    known = v.withColumn("kth", F.lit(0.7))
    before = blocks.pack(known, 12, 400, 2048, more=("kth",))
    after = cells._with_open(before, index, 0.7, 2)
    size = lambda df: df.agg(F.sum(F.length("pack"))).first()[0]
    assert 0 < size(after) - size(before) < 400 * (300 / 8 + 8)
    assert max(len(r.cells) for r in cells._plan(v, index, 0.7, 2).collect()) == 2


def test_maximum_takes_two_waves(spark):
    x = _rows(600)[13:]
    got = max_pair(_frame(spark, x), cells=12, block=40)
    s = _cosines(x)
    assert got.similarity == pytest.approx(s[np.triu_indices(len(x), 1)].max(), abs=1e-12) and got.waves <= 2


def test_copies_of_candidates_are_not_joined(spark):
    v = _frame(spark, _rows())
    got, _ = SIM.duplicate_pairs(v, 0.8, recall=0.99)
    n = {r.rep: r.copies for r in SIM.collapse_copies(v).collect()}
    assert all((r.copies_1, r.copies_2) == (n[r.id_1], n[r.id_2]) for r in got.collect())
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_close_vectors_are_compared_in_strips():
    x = 1 + 0.01 * np.random.default_rng(2).standard_normal((2048, 16))
    plan = candidates.Tables(1, 2, 0.5)
    a = blocks.load(blocks._packed(np.arange(2048), x, np.float64, {}))
    parts = [len(blocks.close_pairs(some, a, 0.8)[0]) for _, some in blocks.strips(a)]
    assert sum(parts) == 2048 ** 2 and max(parts) <= blocks.STRIP * 2048
    keys = np.tile(np.array([0, 2]), 2048)
    a.more.update(codes=np.sort(keys), rows=np.argsort(keys, kind="stable") // 2)
    assert len(candidates._sharing(a, a, 1.0 - 1e-4, plan)[0]) > 0


def test_a_task_holds_few_packed_rows(spark):
    v = _frame(spark, np.random.default_rng(5).standard_normal((4000, 3)))
    packed = blocks.pack(v, 3, 4000, 10)
    most = packed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most <= 2 * blocks.ROWS  # 12 partitions of about 34 rows before


@pytest.mark.parametrize("block", [40, 2048])
@pytest.mark.parametrize("self_", [True, False])
def test_a_table_against_itself(spark, block, self_):
    x = _rows(300)
    v = _frame(spark, x)
    s = np.round(_cosines(x), 9)
    if not self_:
        np.fill_diagonal(s, -1)
    want = {(3 * q, r + 1, 3 * int(c)) for q in range(len(s)) for r, c in enumerate(np.lexsort((np.arange(len(s)), -s[q]))[:3]) if s[q, c] >= 0.7}
    got = SIM.similar_pages(v, v, 3, 0.7, block_size=block, exclude_self=not self_)
    assert {(r.qid, r["rank"], r.id) for r in got.collect()} == want


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs"))
    texts = [f"alpha beta gamma delta number{i // 2} topic{i // 2}" for i in range(30)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


def test_every_document_is_asked(spark, folder):
    got = {r.qid: r.max_similarity for r in QV.j8_max_similarity_documents(spark, folder).collect()}
    assert set(got) == set(range(30)) and set(got.values()) == {1.0}  # every 20th only before: 0 and 20
    assert {r.qid for r in QV.j4_cells_visited_documents(spark, folder).collect()} == set(range(30))
    assert {r.qid for r in QV.j4_similar_documents(spark, folder).collect()} == {0, 20}
