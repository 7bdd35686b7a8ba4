"""Radix selection against Spark's percentile, numpy and Java's order of doubles."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentlens.operators import stats as S
from contentlens.operators.quantiles import exact_quantiles, order_key


def _bits(x: float) -> int:
    n = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -n if x < 0 else n


def test_order_key_is_the_bit_pattern_of_every_power_and_its_neighbours(spark):
    xs = []
    for e in range(-1074, 1024):
        p = math.ldexp(1.0, e)
        xs += [p, np.nextafter(p, 0), np.nextafter(p, math.inf)]
    rng = np.random.default_rng(3)
    xs += rng.standard_normal(2000).tolist() + (rng.standard_normal(2000) * 1e-310).tolist()
    xs = [float(x) for x in xs]
    xs += [-x for x in xs] + [0.0, -0.0, math.inf, -math.inf]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", order_key(F.col("x")).alias("k")).collect()
    assert all(r["k"] == _bits(r["x"]) for r in got)
    odd = spark.createDataFrame([(float("nan"),), (None,)], "x double").select(order_key(F.col("x")).alias("k")).collect()
    assert odd[0]["k"] > _bits(math.inf) and odd[1]["k"] is None


@pytest.mark.parametrize("bits", [3, 13])
def test_quantiles_equal_percentile(spark, bits):
    rng = np.random.default_rng(5)
    n = 3000
    # a wide range, one value that holds a third of all rows, integers, hundredths, neighbours in the last bit
    wide = (rng.standard_normal(n) * 10.0 ** rng.integers(-300, 300, n)).tolist()
    hot = [7.0 if i % 3 == 0 else float(v) for i, v in enumerate(rng.integers(0, 50, n))]
    cents = np.round(rng.normal(60, 20, n), 2).tolist()
    close = [1.0 + int(k) * 2.0 ** -52 for k in rng.integers(0, 1000, n)]
    nulls = [None if i % 2 else v for i, v in enumerate(cents)]
    cols = {"wide": wide, "hot": hot, "cents": cents, "close": close, "nulls": nulls, "none": [None] * n, "one": [None] * (n - 1) + [4.5]}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols)).cache()
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    counts = df.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()
    got = exact_quantiles(df, counts, shares, bits)
    want = df.agg(*[F.percentile(c, shares).alias(c) for c in cols]).first()
    for c in cols:
        assert got[c] == (want[c] if want[c] is not None else [None] * len(shares)), c
    df.unpersist()


def test_infinite_and_nan_values_have_places(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, math.inf, -math.inf, float("nan"), 2.0)], "x double")
    got = exact_quantiles(df, {"x": 5}, [0.0, 0.25, 0.5, 0.75, 1.0])["x"]
    assert got[:4] == [-math.inf, 1.0, 2.0, math.inf] and math.isnan(got[4])


def test_reports_of_an_empty_table_and_of_nulls(spark):
    empty = spark.createDataFrame([], "x double, y int")
    d = {r.feature: r for r in S.describe(empty, ["x", "y"]).collect()}
    assert d["x"]["count"] == 0
    assert d["y"]["q50"] is None and d["y"]["mean"] is None
    b = S.box_plot_stats(empty, ["x"]).first()
    assert b.q1 is None and b.whisker_lo is None and b.n_outliers == 0
    assert S.mean_median(spark.createDataFrame([(None,)], "x double"), ["x"]).first()["median"] is None


def test_every_column_is_settled_in_shared_scans(spark, monkeypatch):
    from contentlens.operators import quantiles as Q
    calls = []
    real = Q._locate
    monkeypatch.setattr(Q, "_locate", lambda rows, todo, shift, above: (calls.append((shift, len(todo))), real(rows, todo, shift, above)))
    df = spark.createDataFrame([(i % 977, round(i * 0.37 % 100, 2)) for i in range(4000)], "a int, b double")
    got = Q.exact_quantiles(df, {"a": 4000, "b": 4000}, [0.25, 0.5, 0.75])
    assert [s for s, _ in calls] == [51, 38]          # two scans for both columns
    assert got["a"] == np.quantile([i % 977 for i in range(4000)], [0.25, 0.5, 0.75]).tolist()
