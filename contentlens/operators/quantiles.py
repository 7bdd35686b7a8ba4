"""Exact quantiles of many columns by radix selection; no task holds more than a fixed number of buckets.

A double is mapped to a 64-bit integer of the same order.  Ranks are located from the top bits
down: rows are counted by column and by the next ``BITS`` bits of the key, the bucket in which a
rank falls is found by a running count, and only rows of such buckets are counted by the bits below.  All columns
and ranks share one scan a level; a rank is settled as soon as its bucket holds one value, so
integers and short decimals take two scans and any doubles at most five.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits a level: a task holds at most 2**BITS counts a column (first level) or boundary bucket.
BITS = 13
_TOP = 2 ** 52


def order_key(x: Column) -> Column:
    """A long that orders as the double ``x`` does: sign, exponent and fraction in turn, NaN last, null for null.

    Both zeros have key 0.  Powers of two and divisions by them are exact, so different doubles have different keys."""
    size = F.abs(x)
    # the logarithm may round across a power of two; numbers below the smallest normal one share its exponent
    near = F.greatest(F.floor(F.log2(size)).cast("double"), F.lit(-1022.0))
    exponent = F.greatest(F.when(size < F.pow(F.lit(2.0), near), near - 1)
                          .when(size >= F.pow(F.lit(2.0), near + 1), near + 1).otherwise(near), F.lit(-1022.0))
    fraction = size / F.pow(F.lit(2.0), exponent) * F.lit(float(_TOP))
    finite = (exponent + 1022).cast("long") * F.lit(_TOP) + fraction.cast("long")
    whole = F.when(F.isnan(x), F.lit(2047 * _TOP + 1)).when(size == float("inf"), F.lit(2047 * _TOP)).otherwise(finite)
    return F.when(x.isNotNull(), F.when(x < 0, -whole).otherwise(whole))


@dataclass
class _Rank:
    """One rank (from 0) of one column: the bucket that holds it, rows below that bucket, the value once known."""
    feature: str
    rank: int
    bucket: int | None = None
    below: int = 0
    value: float | None = None


def _locate(rows: DataFrame, open_ranks: list[_Rank], shift: int, above: int | None) -> None:
    """One scan: move each rank to its bucket of ``key >> shift`` within its bucket of ``key >> above``."""
    spark = rows.sparkSession
    parent = F.lit(0).cast("long") if above is None else F.shiftright("key", above)
    rows = rows.select("feature", parent.alias("parent"), F.shiftright("key", shift).alias("bucket"), "x")
    inside = F.lit(False)
    for feature in sorted({r.feature for r in open_ranks}):
        mine = sorted({r.bucket or 0 for r in open_ranks if r.feature == feature})
        inside = inside | ((F.col("feature") == feature) & F.col("parent").isin(mine))
    counts = rows.filter(inside).groupBy("feature", "parent", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    upto = F.sum("n").over(Window.partitionBy("feature", "parent").orderBy("bucket"))
    # a column's buckets below one parent: at most 2**BITS rows of a window
    cells = counts.withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("n"))
    wanted = spark.range(1).select(F.inline(F.array(*[F.struct(
        F.lit(i).alias("at"), F.lit(r.feature).alias("feature"), F.lit(r.bucket or 0).cast("long").alias("parent"),
        F.lit(r.rank - r.below).cast("long").alias("rest")) for i, r in enumerate(open_ranks)])))
    # one row a rank: bounded by the numbers of columns and shares asked for
    hit = (cells.join(F.broadcast(wanted), ["feature", "parent"])
           .filter((F.col("rest") >= F.col("below")) & (F.col("rest") < F.col("upto"))))
    for row in hit.select("at", "bucket", "below", "lo", "hi").collect():
        r = open_ranks[row["at"]]
        r.bucket, r.below = row["bucket"], r.below + row["below"]
        if shift == 0 or row["lo"] == row["hi"]:
            r.value = row["lo"]


def _keyed(df: DataFrame, cols: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols])
    long = df.select(F.inline(pairs)).filter(F.col("x").isNotNull())
    return long.select("feature", "x", order_key(F.col("x")).alias("key"))


def exact_quantiles(df: DataFrame, counts: dict[str, int], shares: list[float],
                    bits: int = BITS) -> dict[str, list[float | None]]:
    """For each column of ``counts`` (column -> number of non-null rows) the interpolated quantiles at ``shares``.

    The values are those of Spark's ``percentile``: at position p * (n - 1), linear between
    neighbours; nulls take no part, NaN is the greatest value; a column without values gives nulls.
    ``df`` is read once a level, so pass a held or written table.
    """
    asked = {c: [p * (n - 1) for p in shares] for c, n in counts.items() if n}
    ranks = {(c, k): _Rank(c, k) for c, places in asked.items() for at in places for k in (floor(at), ceil(at))}
    todo, above, shift = list(ranks.values()), None, 64 - bits
    rows = _keyed(df, sorted(asked)) if asked else df
    while todo:
        _locate(rows, todo, shift, above)
        todo = [r for r in todo if r.value is None]
        above, shift = shift, max(0, shift - bits)

    def at(c: str, place: float) -> float:
        low, high = ranks[c, floor(place)].value, ranks[c, ceil(place)].value
        if low == high or floor(place) == ceil(place):
            return low
        return (ceil(place) - place) * low + (place - floor(place)) * high

    return {c: [at(c, place) for place in asked[c]] if n else [None] * len(shares) for c, n in counts.items()}
