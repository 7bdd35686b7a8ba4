"""Explicit schemas of every stage (never ``inferSchema``) and column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# CSV form of the features table: keywords ", "-joined, vector as "[a,b,...]".
FEATURES_CSV = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("word_count", T.LongType()),
    T.StructField("sentence_count", T.LongType()),
    T.StructField("flesch_reading_ease", T.DoubleType()),
    T.StructField("top_keywords", T.StringType()),
    T.StructField("embedding", T.StringType()),
])

def require_columns(df: DataFrame, *cols: str) -> DataFrame:
    """Raise ``ValueError`` naming the missing columns; return ``df`` unchanged."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Input must contain columns {list(cols)}; missing {missing}")
    return df
