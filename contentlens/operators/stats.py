"""Aggregations, statistics, sorts and limits (A1-A8, O1-O4, P13, T13 helpers).

Every statistic is one aggregation (partial aggregation on the map side, a
tiny final merge); exact percentiles (interpolating, like pandas) are located by
radix selection, so no task keeps all distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import THIN_WORDS
from .holding import hold, released
from .quantiles import exact_quantiles


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate (a global min/max/count) to every row.

    The right side is a global aggregate — exactly one row by construction —
    so it is broadcast; the join has no key because there is nothing to match.
    """
    return df.join(F.broadcast(one_row), how="inner")


def count_by(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Rows per value, most frequent first (ties by value)."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.desc(name), F.asc(col)))


def _numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns as doubles, held: the passes below read these narrow rows, not the source."""
    return hold(df.select(*[F.col(c).cast("double").alias(c) for c in cols]))


def _report(df: DataFrame, rows: list[tuple], columns: str) -> DataFrame:
    """A report of one row a column of the input, as a DataFrame."""
    return df.sparkSession.createDataFrame(rows, columns)


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """A3: count, mean, std (sample), min, 25/50/75 %, max per column, in long form.

    One scan for the moments of all columns, then the scans of ``exact_quantiles``; runs when called."""
    with released():
        x = _numbers(df, cols)
        one = x.agg(*[F.struct(F.count(c), F.avg(c), F.stddev_samp(c), F.min(c), F.max(c)).alias(c) for c in cols]).first()
        q = exact_quantiles(x, {c: one[c][0] for c in cols}, [0.25, 0.5, 0.75])
        rows = [(c, *one[c][:4], *q[c], one[c][4]) for c in cols]
    return _report(df, rows, "feature string, count long, mean double, std double, min double, "
                             "q25 double, q50 double, q75 double, max double")


def mean_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """A5: mean and exact median per column (the chart reference lines); runs when called."""
    with released():
        x = _numbers(df, cols)
        one = x.agg(*[F.struct(F.count(c), F.avg(c)).alias(c) for c in cols]).first()
        q = exact_quantiles(x, {c: one[c][0] for c in cols}, [0.5])
    return _report(df, [(c, one[c][1], *q[c]) for c in cols], "feature string, mean double, median double")


def histogram(df: DataFrame, col: str, bins: int, feature: str | None = None,
              weight_col: str | None = None) -> DataFrame:
    """A4: equal-width bins over [min, max]; the last bin is closed; empty bins kept.

    Two aggregations: a one-row min/max pass, then the per-bin counts.  The
    bin grid (``bins`` rows) comes from ``range`` and is left-joined so empty
    bins show as 0.  Nothing is collected.  ``weight_col`` counts each row
    that many times (a compact pair table stands for its expanded pairs).
    """
    x = F.col(col).cast("double")
    wt = F.col(weight_col).cast("long") if weight_col else F.lit(1).cast("long")
    vals = df.select(x.alias("x"), wt.alias("_w")).filter(
        F.col("x").isNotNull() & ~F.isnan("x") & (F.col("_w") > 0))
    bounds = vals.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    spark = df.sparkSession
    grid = attach_scalars(spark.range(bins).select(F.col("id").cast("int").alias("bin")), bounds)
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    idx = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / width).cast("int")))
    counts = (attach_scalars(vals, bounds).select(idx.alias("bin"), "_w")
              .groupBy("bin").agg(F.sum("_w").alias("n")))
    out = (grid.join(counts, "bin", "left")
           .select(
               F.lit(feature or col).alias("feature"),
               F.col("bin"),
               (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
               (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
               F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))
    return out


def box_plot_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Quartiles, 1.5 IQR fences, whisker ends (furthest points inside) and outliers.

    Quartiles of all columns by ``exact_quantiles``, then one scan for all whiskers and outlier
    counts, as the fences are known numbers by then; runs when called."""
    with released():
        x = _numbers(df, cols)
        one = x.agg(*[F.count(c).alias(c) for c in cols]).first()
        q = exact_quantiles(x, {c: one[c] for c in cols}, [0.25, 0.5, 0.75])
        boxes, ends = {}, []
        for c in cols:
            q1, mid, q3 = q[c]
            lo, hi = (None, None) if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
            boxes[c] = (q1, mid, q3, lo, hi)
            inside = F.col(c).between(F.lit(lo).cast("double"), F.lit(hi).cast("double"))
            ends.append(F.struct(F.min(F.when(inside, F.col(c))), F.max(F.when(inside, F.col(c))),
                                 F.count(F.when(~inside, 1))).alias(c))
        found = x.agg(*ends).first()
    return _report(df, [(c, *boxes[c], *found[c]) for c in cols],
                   "feature string, q1 double, median double, q3 double, lo_fence double, hi_fence double, "
                   "whisker_lo double, whisker_hi double, n_outliers long")


def thin_vs_normal(df: DataFrame, wc_col: str = "word_count", threshold: int = THIN_WORDS) -> DataFrame:
    """Count of thin (< threshold) and normal pages, both rows always present."""
    counts = df.agg(F.count(F.when(F.col(wc_col) < threshold, 1)).alias("thin"),
                    F.count(F.when(F.col(wc_col) >= threshold, 1)).alias("normal"))
    return counts.select(F.inline(F.array(
        F.struct(F.lit(f"Thin (<{threshold})").alias("segment"), F.col("thin").cast("long").alias("n")),
        F.struct(F.lit(f"Normal (>={threshold})").alias("segment"), F.col("normal").cast("long").alias("n")),
    )))


def top_k(df: DataFrame, order_col: str, k: int, tie_col: str) -> DataFrame:
    """O3: global top-k (planned as TakeOrderedAndProject; no full sort)."""
    return df.orderBy(F.desc(order_col), F.asc(tie_col)).limit(k)


def top_k_per_group(df: DataFrame, group_col: str, order_col: str, k: int, tie_col: str,
                    rank_col: str = "rank") -> DataFrame:
    """K best rows per group via row_number (Spark adds a WindowGroupLimit)."""
    w = Window.partitionBy(group_col).orderBy(F.desc(order_col), F.asc(tie_col))
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def head(df: DataFrame, n: int | None, order_col: str) -> DataFrame:
    """O2: first n rows by row id; ``n=None`` keeps every row."""
    ordered = df.orderBy(order_col)
    return ordered if n is None else ordered.limit(n)


def sort_desc(df: DataFrame, col: str, tie_col: str) -> DataFrame:
    """O1: descending sort with a deterministic tie-break."""
    return df.orderBy(F.desc(col), F.asc(tie_col))
