"""Named queries: name -> (Spark callable, DuckDB oracle SQL or None).

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
input tables.  The SQL twin runs on DuckDB with the same tables registered as
views; ``None`` marks operators that are not SQL-expressible (model fits,
streaming), which get a rows-only check plus their own pytest invariants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = (fn, sql)
        return fn
    return deco


#: Session setting by which a caller (the bench, on one-file tables) asks for ``spread`` inputs.
SPREAD = "contentlens.spread"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from ..sources.readers import spread
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if spark.conf.get(SPREAD, "false") == "true" else df


def all_queries() -> dict[str, tuple[QueryFn, str | None]]:
    from . import queries  # noqa: F401  (registers everything)
    return dict(_QUERIES)
