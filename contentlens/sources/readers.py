"""Sources and sinks (S1-S5) with explicit schemas and column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators.embed import to_dense
from ..schemas import FEATURES_CSV, require_columns
from .csv_records import read_csv_records


#: One set of options for reading and writing: a header, doubled quotes, line ends inside quotes, spaces kept.
CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"',
       "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal rows round-robin to ``partitions`` tasks (default parallelism).

    For inputs known to lie in one file with one row group, whose text work would run in one task.
    Callers ask for it (a full shuffle of the rows); no reader does so by itself."""
    return df.repartition(partitions or df.sparkSession.sparkContext.defaultParallelism)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, named by the header (never by position)."""
    return spark.read.options(**CSV).csv(path)


def read_pages(spark: SparkSession, path: str, fmt: str = "csv", html_col: str = "html_content",
               url_col: str = "url", split_records: bool = False) -> DataFrame:
    """Raw pages (url, html); raises ValueError when the header lacks a column.

    CSV input gets a ``row_id`` (the reference keys rows by position): the id
    is stable for a given file layout, and downstream stages key on it.
    ``split_records`` reads one CSV file in many tasks (``csv_records``; quotes only in quoted fields) and
    numbers rows by their place, whatever the size of a task; the default takes one task a file.
    """
    df = _csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
    require_columns(df, url_col, html_col)
    if fmt == "csv" and split_records:
        df = read_csv_records(spark, path, df.columns, CSV).select("row_id", url_col, html_col)
    elif fmt == "csv":
        df = df.select(F.monotonically_increasing_id().alias("row_id"), url_col, html_col)
    return df


def read_content(spark: SparkSession, path: str, fmt: str = "parquet",
                 text_col: str = "body_text") -> DataFrame:
    """Extracted content; null text becomes ''; ValueError when the text column is missing."""
    df = _csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
    require_columns(df, text_col)
    return df.withColumn(text_col, X.text_or_empty(text_col))


def read_features(spark: SparkSession, path: str, fmt: str = "parquet",
                  embedding_col: str = "embedding") -> DataFrame:
    """S3: features with vectors; text vectors ("[a,b]") are parsed.

    Rows whose vector does not parse keep ``embedding = null`` (they still
    count as pages); similarity operators skip them.  A parquet table of T15
    keeps its sparse vector and gets the dense one as well.
    """
    if fmt == "csv":
        df = _csv(spark, path)
        wanted = [f for f in FEATURES_CSV.fields if f.name != "embedding"]
        require_columns(df, embedding_col, *(f.name for f in wanted))
        df = df.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted),
                       V.parse_embedding(embedding_col).alias(embedding_col),
                       F.monotonically_increasing_id().alias("row_id"))
        return df.withColumn("top_keywords", F.split(F.coalesce("top_keywords", F.lit("")), ", "))
    df = spark.read.format(fmt).load(path)
    if embedding_col not in df.columns and {"embedding_indices", "embedding_values"} <= set(df.columns):
        df = df.withColumn(embedding_col, to_dense("embedding_indices", "embedding_values"))
    return require_columns(df, embedding_col)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a stage.  CSV flattens arrays (keywords ", "-joined, vectors "[a,b]"; the sparse vector of T15
    becomes its dense ``embedding``) and is read back by S1-S3.

    Never write to the path being read: Spark reads lazily, so write to a new
    path (the reference overwrote its input in place).
    """
    if fmt != "csv":
        df.write.mode(mode).format(fmt).save(path)
        return
    out = df
    if {"embedding_indices", "embedding_values"} <= set(df.columns):
        out = out.withColumn("embedding", to_dense("embedding_indices", "embedding_values")).drop(
            "embedding_indices", "embedding_values")
    for f in out.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "array<string>":
            out = out.withColumn(f.name, F.array_join(f.name, ", "))
        elif kind in ("array<float>", "array<double>"):
            out = out.withColumn(f.name, V.embedding_to_string(f.name))
    out.write.mode(mode).options(**CSV).csv(path)


def save_model(model, path: str) -> None:
    """Persist a fitted pipeline model (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Load a pipeline model; ``None`` only when nothing is at ``path``.  Any other fault is raised."""
    from pyspark.ml import PipelineModel
    spark = SparkSession.getActiveSession()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return PipelineModel.load(path)
