"""Registered model queries (M1-M8) and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import model as M
from . import oracle_sql as O
from .queries import labelled_docs
from .registry import register

SEED, TEST = 42, 0.3
TREES = 500          # the reference forest: 500 trees, depth 10, seed 42


def split_docs(spark, sf):
    return M.stratified_split(labelled_docs(spark, sf), "quality_label", "doc_id", TEST, SEED)


_SPLIT = f"""{O.DOC_FEATURES},
lab AS (SELECT doc_id, word_count, {O.quality_label('word_count', 'flesch_reading_ease')} AS quality_label,
               ('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR), 1, 15))::BIGINT AS k FROM feat),
cnt AS (SELECT quality_label, count(*) AS n_c FROM lab GROUP BY 1),
tot AS (SELECT sum(n_c) AS n, ceil({TEST}::DOUBLE * sum(n_c))::BIGINT AS t FROM cnt),
c AS (SELECT quality_label, (n_c * t) // n AS base, (n_c * t) % n AS rem, t FROM cnt, tot),
c2 AS (SELECT *, t - sum(base) OVER () AS lft, row_number() OVER (ORDER BY rem DESC, quality_label) AS rr FROM c),
sh AS (SELECT quality_label, base + CASE WHEN rr <= lft THEN 1 ELSE 0 END AS share FROM c2),
rk AS (SELECT doc_id, word_count, quality_label,
              row_number() OVER (PARTITION BY quality_label ORDER BY k, doc_id) AS r FROM lab),
sp AS (SELECT doc_id, word_count, quality_label, CASE WHEN r <= share THEN 'test' ELSE 'train' END AS split
       FROM rk JOIN sh USING (quality_label)),
te AS (SELECT quality_label AS actual, {O.baseline_label('word_count')} AS predicted FROM sp WHERE split = 'test')"""


@register("m1_stratified_split", f"""
WITH {_SPLIT}
SELECT doc_id, quality_label, split FROM sp""")
def m1_stratified_split(spark, sf):
    return split_docs(spark, sf).select("doc_id", "quality_label", "split")


def _baseline_test(spark, sf):
    s = split_docs(spark, sf).filter(F.col("split") == "test")
    return s.select(F.col("quality_label").alias("actual"), L.baseline_label("word_count").alias("predicted"))


_GRID = "(SELECT * FROM (VALUES ('Low'), ('Medium'), ('High')) v(l))"
_CM = f"""cm AS (SELECT a.l AS actual, p.l AS predicted, coalesce(x.n, 0)::BIGINT AS n
       FROM {_GRID} a CROSS JOIN {_GRID} p
       LEFT JOIN (SELECT actual, predicted, count(*) AS n FROM te GROUP BY 1, 2) x
         ON x.actual = a.l AND x.predicted = p.l)"""


@register("m5_confusion_matrix", f"""
WITH {_SPLIT}, {_CM}
SELECT actual, predicted, n FROM cm""")
def m5_confusion_matrix(spark, sf):
    return M.confusion_matrix(_baseline_test(spark, sf), "actual", "predicted")


_REPORT = f"""{_CM},
per AS (SELECT l.label,
          CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS precision,
          CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support
        FROM (SELECT actual AS label, sum(n) FILTER (WHERE actual = predicted)::DOUBLE AS tp,
                     sum(n)::DOUBLE AS support FROM cm GROUP BY 1) l
        JOIN (SELECT predicted AS label, sum(n)::DOUBLE AS npred FROM cm GROUP BY 1) p USING (label)),
per2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                        ELSE 0.0 END AS f1 FROM per),
rep AS (
  SELECT label, precision, recall, f1, support::BIGINT AS support FROM per2
  UNION ALL
  SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM per2
  UNION ALL
  SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
         sum(f1 * support) / sum(support), sum(support)::BIGINT FROM per2)"""


@register("m6_classification_report", f"""
WITH {_SPLIT}, {_REPORT}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep""")
def m6_classification_report(spark, sf):
    r = M.classification_report(_baseline_test(spark, sf), "actual", "predicted")
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("m4_baseline_metrics", f"""
WITH {_SPLIT}, {_REPORT}
SELECT round((SELECT avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) FROM te), 6) AS accuracy,
       round((SELECT f1 FROM rep WHERE label = 'weighted avg'), 6) AS f1""")
def m4_baseline_metrics(spark, sf):
    r = M.accuracy_f1(_baseline_test(spark, sf), "actual", "predicted")
    return r.select(F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


def _metrics_sql(predicted, prefix=""):
    """One row: accuracy and support-weighted F1 of ``predicted`` against ``actual`` in te2."""
    return f"""(SELECT avg(CASE WHEN actual = {predicted} THEN 1.0 ELSE 0.0 END) AS {prefix}accuracy,
       (SELECT sum(support * CASE WHEN tp > 0 THEN 2 * (tp / npred) * (tp / support) / (tp / npred + tp / support) ELSE 0.0 END)
               / sum(support)
        FROM (SELECT l, (SELECT count(*) FROM te2 WHERE actual = l AND {predicted} = l)::DOUBLE AS tp,
                     (SELECT count(*) FROM te2 WHERE actual = l)::DOUBLE AS support,
                     (SELECT count(*) FROM te2 WHERE {predicted} = l)::DOUBLE AS npred FROM {_GRID} g) c) AS {prefix}f1
       FROM te2)"""


@register("m8_evaluate_fixed_predictions", f"""
WITH {_SPLIT},
te2 AS (SELECT quality_label AS actual, {O.baseline_label('word_count')} AS baseline,
               CASE WHEN word_count >= 1000 THEN 'High' WHEN word_count < 300 THEN 'Low' ELSE 'Medium' END AS predicted
        FROM sp WHERE split = 'test')
SELECT round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(baseline_accuracy, 6) AS baseline_accuracy,
       round(baseline_f1, 6) AS baseline_f1, round(accuracy - baseline_accuracy, 6) AS accuracy_gain,
       round(f1 - baseline_f1, 6) AS f1_gain
FROM {_metrics_sql('predicted')} m, {_metrics_sql('baseline', 'baseline_')} b""")
def m8_evaluate_fixed_predictions(spark, sf):
    """M8 on predictions by a fixed rule of the word count, which SQL can repeat (a fitted forest it cannot)."""
    w = F.col("word_count")
    test = split_docs(spark, sf).filter(F.col("split") == "test").select(
        "quality_label", L.baseline_label(w).alias("baseline"),
        F.when(w >= 1000, "High").when(w < 300, "Low").otherwise("Medium").alias("predicted"))
    out = M.evaluate(test, "quality_label", "predicted", "baseline")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


# ---------------------------------------------------------- model (rows-only)
def _fit(spark, sf):
    s = split_docs(spark, sf)
    model = M.train_quality_model(s.filter(F.col("split") == "train"), num_trees=TREES)
    return s, model


@register("m2_m3_train_predict")
def m2_m3_train_predict(spark, sf):
    s, model = _fit(spark, sf)
    return M.predict_quality(model, s).select("doc_id", "quality_label", "split", "predicted_quality")


@register("m7_feature_importance")
def m7_feature_importance(spark, sf):
    _, model = _fit(spark, sf)
    return M.feature_importance(model, spark)


@register("m8_evaluate_predictions")
def m8_evaluate_predictions(spark, sf):
    s, model = _fit(spark, sf)
    test = M.predict_quality(model, s.filter(F.col("split") == "test"))
    test = test.withColumn("baseline", L.baseline_label("word_count"))
    return M.evaluate(test, "quality_label", "predicted_quality", "baseline")


from . import queries_nlp  # noqa: E402,F401
