"""Mixing sources to target weights by hash-threshold histograms; DataFrame operations only.

Targets: sources share all words by weight, none gets more than ``CAP`` times what it has, and the excess is
shared anew by weight.  That fixed point is target = min(CAP * size, level * weight) for the one
level at which targets add up, found over sources ordered by CAP * size / weight.

Taking: a document has a fixed 40-bit hash of its id and text.  A source whose target is f whole passes and a rest takes
each document f times, and once more below a hash threshold.  The threshold is found without
sorting documents: words are summed by source and hash bucket (1,024 buckets), the bucket in which
the running sum crosses the budget is the boundary, and only that bucket is summed again by the next ten bits,
four times.  At the last level the boundary cell is taken if that comes nearer to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, free_name

WEIGHTS = (5, 2, 1)
CAP = 3
LEVEL_BITS, LEVELS = 10, 4


def document_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    """First 40 bits of the md5 of ``<id>:<text>`` (nulls: empty), so that null or repeated ids do not share a cell."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, 10), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) of rows (source, size); one row per source, nulls are a source, last."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = (by_source.withColumn("at", (place % len(weights)).cast("int"))
               .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("at") + 1).cast("double"))
               .withColumn("limit", (F.col("source_size") * cap).cast("double")))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
             / F.sum("weight").over(rest))
    # the first source that the level does not fill sets it; before that one every source is at its limit
    leveled = weighed.withColumn("level", level).withColumn(
        "open", F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level")))
    first_open = F.first("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.select("source", "source_size",
                          F.least("limit", F.coalesce(first_open, F.lit(0.0)) * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, source_size, target, passes, below): take ``passes`` times, once more where hash < below."""
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = wanted.withColumn("passes", full).withColumn(
        "budget", F.col("target") - full * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    for step in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - step)
        # documents of the boundary cell only: those whose leading bits are the prefix found so far
        inside = sized.join(state.select(F.col("source").alias("s"), "prefix"),
                            F.col("source").eqNullSafe(F.col("s"))
                            & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix")))
        cells = (inside.groupBy("source", F.shiftright("hash", shift).bitwiseAND((1 << LEVEL_BITS) - 1).alias("cell"))
                 .agg(F.sum("size").alias("cell_size")))
        upto = Window.partitionBy("source").orderBy("cell")
        run = (cells.withColumn("above", F.sum("cell_size").over(upto))
               .join(state.select(F.col("source").alias("s"), "budget"), F.col("source").eqNullSafe(F.col("s"))))
        whole = (F.col("above") <= F.col("budget")).cast("long")
        # the boundary is the first cell that does not fit whole; all before it are taken
        edge = run.groupBy("source").agg(
            F.min(F.when(whole == 0, F.struct(F.col("cell"), F.col("cell_size"), F.col("above")))).alias("edge"),
            F.max(F.when(whole == 1, F.col("above"))).alias("taken"))
        found = edge.select(F.col("source").alias("s"),
                            F.coalesce("edge.cell", F.lit(1 << LEVEL_BITS)).alias("cell"), F.col("edge.cell_size").alias("cell_size"),
                            F.coalesce(F.col("edge.above") - F.col("edge.cell_size"), "taken", F.lit(0)).alias("spent"))
        joined = state.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
        budget = F.col("budget") - F.coalesce("spent", F.lit(0))
        cell = F.coalesce("cell", F.lit(0))
        if step == LEVELS - 1:  # the last cell is taken or left, whichever is nearer
            cell = cell + F.when(F.col("cell_size") <= 2 * budget, 1).otherwise(0)
        state = cut(joined.select("source", "source_size", "target", "passes", budget.alias("budget"),
                                  (F.col("prefix") * (1 << LEVEL_BITS) + cell).alias("prefix")), f"edge{step}")
    return state.select("source", "source_size", "target", "passes", F.col("prefix").alias("below"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id",
         text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(sized documents: doc_id, source, size, hash; thresholds per source)."""
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                            document_size(F.col(text_col)).alias("size"), document_hash(F.col(id_col), F.col(text_col)).alias("hash")), "sized")
    return sized, thresholds(sized, cut(targets(sized, weights, cap), "targets"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target (of its source), taken.

    Null or empty texts have size 0 and take 0; a null source is a source of its own, last in order; rows with
    one id and one text share a hash and so are taken alike; other columns are not read; an empty table gives
    an empty result.  A rerun takes the same documents."""
    sized, limits = plan(docs, weights, cap, id_col, text_col, source_col)
    limits = limits.withColumnRenamed("source", "s")
    more = (F.col("hash") < F.col("below")).cast("long")
    return sized.join(limits, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + more)).alias("taken"))


def repeat_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id",
                     text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it (0 to ``cap`` times), columns unchanged.

    Null texts have no words and are taken with their source; null sources are one source; an empty table stays empty; columns of any name pass."""
    _, limits = plan(docs, weights, cap, id_col, text_col, source_col)
    source, passes, below = (free_name(docs, f"_mix_{c}") for c in ("source", "passes", "below"))
    limits = limits.select(F.col("source").alias(source), F.col("passes").alias(passes), F.col("below").alias(below))
    more = (document_hash(F.col(id_col), F.col(text_col)) < F.col(below)).cast("long")
    times = F.array_repeat(F.lit(0), (F.col(passes) + more).cast("int"))
    turn = free_name(docs, "_turn")
    return (docs.join(limits, F.col(source_col).eqNullSafe(F.col(source)))
            .withColumn(turn, F.explode(times)).select(*(F.col(f"`{c}`") for c in docs.columns)))


ORACLE = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 10))::BIGINT AS hash FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM src),
weighed AS (SELECT source, source_size, CASE place WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                   3.0::DOUBLE * source_size AS cap FROM ranked),
lev AS (SELECT a.source, a.weight, a.cap,
          ((SELECT sum(source_size) FROM weighed)::DOUBLE
           - coalesce((SELECT sum(b.cap) FROM weighed b WHERE b.cap / b.weight < a.cap / a.weight), 0))
          / (SELECT sum(b.weight) FROM weighed b WHERE b.cap / b.weight >= a.cap / a.weight) AS level FROM weighed a),
lv AS (SELECT arg_min(level, cap / weight) AS level FROM lev WHERE level * weight <= cap),
goal AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM lv)) AS target FROM weighed),
passes AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM goal),
cells AS (SELECT source, hash, sum(size) AS cell FROM sized GROUP BY source, hash),
runs AS (SELECT source, hash, cell, sum(cell) OVER (PARTITION BY source ORDER BY hash) AS upto FROM cells),
edges AS (
  SELECT p.source, min(CASE WHEN upto > target - passes * source_size THEN hash END) AS hash,
         arg_min(cell, hash) FILTER (WHERE upto > target - passes * source_size) AS cell,
         arg_min(upto, hash) FILTER (WHERE upto > target - passes * source_size) AS upto
  FROM runs r JOIN passes p ON r.source IS NOT DISTINCT FROM p.source GROUP BY p.source)
SELECT s.doc_id, s.size, p.source_size, p.target,
       (s.size * (p.passes + CASE WHEN e.hash IS NULL OR s.hash < e.hash
          OR s.hash = e.hash AND e.cell <= 2 * (p.target - p.passes * p.source_size - (e.upto - e.cell)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN passes p ON s.source IS NOT DISTINCT FROM p.source JOIN edges e ON s.source IS NOT DISTINCT FROM e.source
"""
