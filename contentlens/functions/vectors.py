"""Vector column functions (X12, X13, J1) as native higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, strip_outer


def parse_embedding(c) -> Column:
    """X12: "[a, b, ...]" -> array<float>; null when any element is not a number."""
    s = F.regexp_replace(_col(c), r"^[\[\]]+|[\[\]]+$", "")
    vals = F.transform(F.split(s, ","), lambda x: strip_outer(x).try_cast("float"))
    bad = (strip_outer(s) == "") | F.exists(vals, lambda v: v.isNull())
    return F.when(_col(c).isNull() | bad, F.lit(None)).otherwise(vals)


def embedding_to_string(c) -> Column:
    """Array -> "[a,b,...]" (only for the CSV edge; arrays stay native)."""
    return F.concat(F.lit("["),
                    F.array_join(F.transform(_col(c), lambda x: x.cast("string")), ","),
                    F.lit("]"))


def dot(a, b) -> Column:
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_similarity(a, b) -> Column:
    """A.b / (|a| |b|); 0 when either vector is all zeros."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))
