"""Shared helpers: the shared folder, written intermediate tables, label split, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but ASCII white space (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting (tests) gets a temporary folder; on a
    cluster a missing setting is an error, as executors would write to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="contentlens-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, work is done once,
    and a lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/contentlens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def split_remainder(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; a null id counts as empty text.  Remainder 2 is the held-out part."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def training_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int,
                    id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """Texts of a bounded, class-balanced, repeatable sample of labelled rows outside the held-out part.

    Returns (rows of ``y`` int and ``text``; row counts per class over **all** training labels).
    At most ``per_class`` documents of each class (smallest md5 of the id); of conflicting
    labels for one id the smaller holds; of repeated ids the text with the smallest md5 is taken, so the
    sample has one row an id; null ids, null labels and labels other than 0/1 take no part.
    """
    known = (labels.select(F.col(id_col).alias("_id"), F.col(target).cast("int").alias("y"))
             .filter(F.col("_id").isNotNull() & F.col("y").isin(0, 1) & (split_remainder(F.col("_id")) != 2))
             .groupBy("_id").agg(F.min("y").alias("y")))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    key = F.md5(F.col("_id").cast("string"))
    picked = [known.filter(F.col("y") == y).orderBy(key, "_id").limit(per_class) for y in sorted(counts)]
    if not picked:
        return docs.sparkSession.createDataFrame([], "y int, text string"), counts
    ids = picked[0]
    for more in picked[1:]:
        ids = ids.union(more)
    # at most 2 * per_class ids: the bound of this broadcast is a parameter
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
            .join(F.broadcast(ids), "_id").select("_id", "y", F.coalesce("text", F.lit("")).alias("text")))
    # partial results first: an id that a third of all rows share costs one text a task
    one = rows.groupBy("_id").agg(F.min("y").alias("y"), F.min_by("text", F.md5("text")).alias("text"))
    return one.select("y", "text"), counts


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node id that each end of ``edges`` (a, b: long) reaches.

    Min-label hooking with pointer jumping: every round each root hooks onto the smallest
    label seen next to any member of its tree, then every node jumps to its label's label,
    so the rounds grow with the logarithm of the longest path.  Labels are written to the shared folder each
    round.  A hub costs one partially aggregated row per task; its join side is left to
    Spark's skew handling.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.filter("a <> b").distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    for _ in range(max_rounds):
        near = (both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("far")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("far").alias("far")))
        seen = labels.join(near, "node").select("node", "root", F.least("root", "far").alias("low"))
        hook = seen.groupBy(F.col("root").alias("old")).agg(F.min("low").alias("hooked"))
        hooked = seen.join(hook, F.col("root") == F.col("old"), "left").select(
            "node", F.col("root").alias("was"), F.least("low", "hooked").alias("root"))
        hooked = cut(hooked, "hooked")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = hooked.join(up, "root", "left").select(
            "node", "was", F.least("root", F.coalesce("up", "root")).alias("root"))
        jumped = cut(jumped, "labels")
        changed = jumped.filter("root <> was").limit(1).count()
        labels = jumped.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError("connected components did not settle")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


LONG = T.LongType()
