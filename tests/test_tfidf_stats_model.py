"""TF-IDF, statistics and model fixtures (FIXTURES.md sections 7 and 8)."""

import pytest
from pyspark.sql import functions as F

from contentlens.operators import model as M
from contentlens.operators import stats as S
from contentlens.operators import tfidf as T


@pytest.fixture(scope="module")
def fruit(spark):
    return spark.createDataFrame([(1, "apple apple banana"), (2, "banana cherry"), (3, "")],
                                 "doc_id long, text string")


def test_tfidf_weights(spark, fruit):
    w = {(r.doc, r.term): r.weight for r in T.keyword_matrix(fruit, stopwords=[]).collect()}
    assert w[(1, "apple")] == pytest.approx(0.942156, abs=1e-6)
    assert w[(1, "banana")] == pytest.approx(0.335176, abs=1e-6)
    assert w[(2, "cherry")] == pytest.approx(0.814802, abs=1e-6)
    assert w[(2, "banana")] == pytest.approx(0.579739, abs=1e-6)


def test_top_keywords(spark, fruit):
    got = {r.doc_id: r.top_keywords for r in T.top_keywords(fruit, stopwords=[]).collect()}
    assert got == {1: "apple, banana", 2: "cherry, banana", 3: ""}
    empty = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert {r.top_keywords for r in T.top_keywords(empty).collect()} == {""}


def test_corpus_keyword_means(spark, fruit):
    m = T.keyword_matrix(fruit, stopwords=[])
    means = {r.term: r.s / 2 for r in m.groupBy("term").agg(F.sum("weight").alias("s")).collect()}
    assert means["apple"] == pytest.approx(0.471078, abs=1e-6)
    assert means["banana"] == pytest.approx(0.457457, abs=1e-6)
    assert means["cherry"] == pytest.approx(0.407401, abs=1e-6)


def test_describe_hist_box(spark):
    df = spark.createDataFrame([(float(x),) for x in range(5)], "x double")
    d = S.describe(df, ["x"]).first()
    assert (d["count"], d["mean"], d["min"], d["q25"], d["q50"], d["q75"], d["max"]) == (5, 2.0, 0.0, 1.0, 2.0, 3.0, 4.0)
    assert d["std"] == pytest.approx(1.581139, abs=1e-6)
    h = [(r.bin, r.n) for r in S.histogram(df, "x", 2).orderBy("bin").collect()]
    assert h == [(0, 2), (1, 3)]
    h3 = [r.n for r in S.histogram(spark.createDataFrame([(0.0,), (10.0,)], "x double"), "x", 5).orderBy("bin").collect()]
    assert h3 == [1, 0, 0, 0, 1]                       # empty bins kept
    b = S.box_plot_stats(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)], "x double"), ["x"]).first()
    assert (b.q1, b.median, b.q3, b.lo_fence, b.hi_fence) == (2.0, 3.0, 4.0, -1.0, 7.0)
    assert (b.whisker_lo, b.whisker_hi, b.n_outliers) == (1.0, 4.0, 1)


def test_stratified_split_sizes(spark):
    rows = [(i, lab) for i, lab in enumerate(["Low"] * 49 + ["Medium"] * 18 + ["High"] * 14)]
    df = spark.createDataFrame(rows, "id long, quality_label string")
    s = M.stratified_split(df, "quality_label", "id", 0.3, 42)
    got = {r.quality_label: r.n for r in s.filter("split = 'test'").groupBy("quality_label").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"Low": 15, "Medium": 6, "High": 4}
    assert s.count() == 81
    # the same split under a different shuffle layout
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        again = {r.id for r in M.stratified_split(df, "quality_label", "id", 0.3, 42).filter("split='test'").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert again == {r.id for r in s.filter("split='test'").collect()}


def _pred_df(spark, pairs):
    return spark.createDataFrame(pairs, "actual string, predicted string")


def test_golden_metrics(spark):
    pairs = ([("Low", "Low")] * 15 + [("Medium", "Medium")] * 6 + [("High", "High")] * 2
             + [("High", "Medium")] * 2)
    p = _pred_df(spark, pairs)
    cm = {(r.actual, r.predicted): r.n for r in M.confusion_matrix(p, "actual", "predicted").collect()}
    assert len(cm) == 9 and cm[("High", "Medium")] == 2 and cm[("Low", "High")] == 0
    m = M.accuracy_f1(p, "actual", "predicted").first()
    assert m.accuracy == pytest.approx(0.92) and m.f1 == pytest.approx(0.912, abs=5e-4)
    rep = {r.label: r for r in M.classification_report(p, "actual", "predicted").collect()}
    assert (round(rep["High"].precision, 2), round(rep["High"].recall, 2), round(rep["High"].f1, 2)) == (1.0, 0.5, 0.67)
    assert (round(rep["Medium"].precision, 2), round(rep["Medium"].recall, 2), round(rep["Medium"].f1, 2)) == (0.75, 1.0, 0.86)


def test_small_metrics_zero_division(spark):
    p = _pred_df(spark, [("Low", "Low"), ("Low", "Medium"), ("Medium", "Medium"), ("High", "High"), ("High", "Medium")])
    m = M.accuracy_f1(p, "actual", "predicted").first()
    assert m.accuracy == pytest.approx(0.6) and m.f1 == pytest.approx(0.6333, abs=1e-4)
    never = _pred_df(spark, [("Low", "Medium"), ("Medium", "Medium")])
    rep = {r.label: r for r in M.classification_report(never, "actual", "predicted").collect()}
    assert rep["Low"].precision == 0.0 and rep["High"].support == 0


def test_model_train_predict_and_unknown(spark):
    rows = []
    for i in range(120):
        wc = [100, 800, 2000][i % 3]
        r = [20.0, 60.0, 60.0][i % 3]
        rows.append((i, wc + i, 10 + i % 7, r + (i % 5), ["Low", "Medium", "High"][i % 3]))
    df = spark.createDataFrame(rows, "id long, word_count long, sentence_count long, "
                                     "flesch_reading_ease double, quality_label string")
    model = M.train_quality_model(df, num_trees=10, max_depth=4)
    pred = M.predict_quality(model, df)
    acc = pred.agg(F.avg((F.col("predicted_quality") == F.col("quality_label")).cast("double"))).first()[0]
    assert acc > 0.9
    imp = M.feature_importance(model, spark).collect()
    assert len(imp) == 3 and abs(sum(r.importance for r in imp) - 1) < 1e-6
    assert {r.predicted_quality for r in M.predict_quality(None, df).collect()} == {"Unknown"}


def test_unbounded_vocabulary_is_not_broadcast(spark):
    from .conftest import SMOKE
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    out = T.top_keywords(docs, max_features=None)
    assert out.count() == docs.count()

    def hints(mf):
        plan = T.keyword_matrix(docs, max_features=mf)._jdf.queryExecution().optimizedPlan().toString()
        return plan.lower().count("broadcast")
    # the bounded vocabulary carries one more broadcast hint than the unbounded one
    assert hints(None) < hints(100)
