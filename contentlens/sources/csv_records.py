"""Quoted CSV whose records span lines, cut into records by many tasks a file.

A reader of whole files must see every earlier quote to know whether a line end is inside a field, so it takes a file in
one task.  Here the lines of each byte range are counted first: a range needs only the parity of its quotes from the
ranges before it, which is a prefix sum over one row a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of a line without content: nothing, or what is left of a line end of two characters.
BLANK = ("", "\r")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its place: file, start of its byte range, order within the range, quotes before and in it."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("at"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    within = Window.partitionBy("file", "range").orderBy("at")
    return (lines.select("file", "range", "at", "value", (quotes % 2).alias("odd"), F.col("value").isin(*BLANK).alias("blank"))
            .withColumn("before", (F.sum("odd").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("odd")) % 2))


def _ranges(lines: DataFrame) -> DataFrame:
    """One row a byte range: whether it starts inside quotes, how many records start before it and in it.

    The prefix over files takes one row a file, that over ranges one row a range of one file."""
    def starts(inside: int) -> F.Column:
        return F.count(F.when((F.col("before") == inside) & ~F.col("blank"), 1))

    one = lines.groupBy("file", "range").agg((F.sum("odd") % 2).alias("odd"), starts(0).alias("outside"), starts(1).alias("inside"))
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("open", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    one = one.withColumn("n", F.when(F.col("open") == 0, F.col("outside")).otherwise(F.col("inside")))
    one = one.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return one.select("file", "range", "open", "n", "first")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): the records of each file numbered from 0, the header included; ``text`` keeps its line ends.

    Quotes must be doubled inside quoted fields and stand in quoted fields only (RFC 4180, as ``write_table`` writes).
    Lines without content outside quotes are no records.  Every line is shuffled once, to the task of its byte range;
    of its records only the first and the last, which other ranges may continue, are shuffled again.  Numbers do not
    depend on the ranges' size.
    """
    lines = _lines(spark, path)
    # not persisted: a cached table of ranges would be found again by a later read under another range size
    placed = lines.join(_ranges(lines), ["file", "range"])
    start = (F.col("before") + F.col("open")) % 2 == 0
    within = Window.partitionBy("file", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.filter(~(start & F.col("blank"))).withColumn("nth", F.sum(start.cast("int")).over(within))
    pieces = placed.groupBy("file", "range", "n", "first", "nth").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n").alias("text"))
    edge = (F.col("nth") == 0) | (F.col("nth") == F.col("n"))
    number = (F.col("first") + F.col("nth") - 1).alias("record")
    whole = pieces.filter(~edge).select("file", number, "text")
    # a record that spans ranges: its pieces in the order of the file
    parts = pieces.filter(edge).groupBy("file", number).agg(F.sort_array(F.collect_list(F.struct("range", "text"))).alias("parts"))
    return whole.unionAll(parts.select("file", "record", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text")))


def read_csv_records(spark: SparkSession, path: str, names: list[str], options: dict) -> DataFrame:
    """The columns ``names`` (all strings) of every record but the headers, and ``row_id``: the record's place among all files."""
    counts = _ranges(_lines(spark, path)).groupBy("file").agg(F.greatest(F.sum("n") - 1, F.lit(0)).alias("records"))
    # one row a file passes through this window, no record does
    before = counts.select("file", F.coalesce(F.sum("records").over(
        Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    told = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k != "header"}
    text = F.regexp_replace("text", r"\r\z", "")  # the rest of a line end of two characters
    return (csv_records(spark, path).filter("record > 0").join(before, "file")
            .select((F.col("before") + F.col("record") - 1).alias("row_id"), F.from_csv(text, schema, told).alias("fields"))
            .select("row_id", "fields.*"))
