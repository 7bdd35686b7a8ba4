"""Scoped persistence: tables kept inside a ``released()`` block are dropped when it ends."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from threading import local

from pyspark import StorageLevel
from pyspark.sql import DataFrame

_scopes = local()


def hold(df: DataFrame) -> DataFrame:
    """``df`` persisted (MEMORY_AND_DISK, rebuilt from lineage if lost); the innermost open scope releases it.

    Outside any scope it stays, as for a result that is returned lazily, until the caller clears the cache."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(df)
    return df


@contextmanager
def released() -> Iterator[None]:
    """Release every table held within the block; the block must have written or collected its results."""
    _scopes.open = [*getattr(_scopes, "open", []), []]
    try:
        yield
    finally:
        *_scopes.open, mine = _scopes.open
        for df in mine:
            df.unpersist()
