"""SimHash near-duplicates by covering locality-sensitive hashing (after Pagh 2016).

Fingerprints: 64 bits over the XXH64 hashes of word shingles.  Links: at most ``radius`` differing bits.
Every bit position gets a non-zero vector of ``radius + 1`` bits; table v keeps the positions whose
vector has an odd product with v.  Any ``radius`` positions span less than the whole space, so some
table v drops all of them: two fingerprints within the radius agree in that table's key for certain.

Equal fingerprints are collapsed first.  A key shared by more than ``BUCKET`` distinct fingerprints is
refined by the same construction over the bits its table drops (a pair within the radius still agrees in one
refined key), so no bucket is ever collected whole beyond that size.  A bucket yields a forest (each
linked fingerprint and the smallest one of its part), not its pairs; connected components join them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, cut, free_name

WORDS = 3
RADIUS = 3
BUCKET = 1024   # largest bucket compared inside one task
SEED = 42


def fingerprint(text: str, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash; no words: 0."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not w:
        return 0
    if len(w) < words:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = h[i:i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, words: int = WORDS) -> Column:
    """Arrow-batched: text -> fingerprint as signed long (null counts as empty)."""
    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t or "", words) for t in texts), np.uint64, len(texts)).view(np.int64))

    return run(F.coalesce(text, F.lit("")))


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks over the given bit positions."""
    vectors = range(1, 1 << (radius + 1))
    given = {b: vectors[i % len(vectors)] for i, b in enumerate(bits)}
    return [sum(1 << b for b, m in given.items() if (m & v).bit_count() & 1) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mask_levels(radius: int = RADIUS, levels: int = 3) -> list[list[int]]:
    """masks[l][t]: bits that table t of level l compares; each table's subtables are t * tables + 0.."""
    masks = [covering_masks(list(range(64)), radius)]
    for _ in range(levels - 1):
        masks.append([m | sub for m in masks[-1]
                      for sub in covering_masks([b for b in range(64) if not m >> b & 1], radius)])
    return masks


def bucket_forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(member, smallest member of its part) for parts of two and more within one bucket."""
    rest, out = np.sort(values), []
    as_bits = rest.view(np.uint64)
    while len(rest) > 1:
        root, todo = int(rest[0]), [as_bits[0]]
        rest, as_bits = rest[1:], as_bits[1:]
        while todo and len(rest):
            near = np.bitwise_count(as_bits ^ todo.pop()) <= radius
            if near.any():
                out += [(int(x), root) for x in rest[near]]
                todo += list(as_bits[near])
                rest, as_bits = rest[~near], as_bits[~near]
    return out


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): a forest that connects exactly what links of ``radius`` bits connect.

    ``distinct`` has one row per fingerprint (column ``fp``)."""
    tables = (1 << (radius + 1)) - 1
    masks = mask_levels(radius)

    def forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [e for v in pdf["members"] for e in bucket_forest(np.asarray(v, np.int64), radius)]
            yield pd.DataFrame(rows, columns=["a", "b"], dtype=np.int64)

    found: DataFrame | None = None
    rows = distinct.select("fp", F.lit(0).alias("t"))
    for level, of_level in enumerate(masks):
        lits = F.array(*(F.lit(_signed(m)) for m in of_level))
        keys = (rows.select("fp", F.explode(F.sequence(F.col("t") * tables, F.col("t") * tables + tables - 1)).alias("t"))
                .select("fp", "t", F.col("fp").bitwiseAND(F.element_at(lits, F.col("t") + 1)).alias("k")))
        shared = keys.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
        met = cut(keys.join(shared, ["t", "k"]), f"met{level}")
        last = level == len(masks) - 1  # a last-level bucket has at most 2 ** (its few free bits) values
        small = met if last else met.filter(F.col("n") <= bucket)
        edges = small.groupBy("t", "k").agg(F.collect_list("fp").alias("members")).select("members").mapInPandas(
            forest, "a long, b long")
        found = edges if found is None else found.union(edges)
        rows = met.filter(F.col("n") > bucket).select("fp", "t")
        if last or not rows.limit(1).count():
            break
    return found


def components(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(fp, component_id, first_fp): of each distinct fingerprint, for rows (doc_id, fp).

    ``component_id`` is the smallest doc_id reachable (null ids only if there are no others);
    ``first_fp`` is the fingerprint of that document's row (smallest, if repeated)."""
    classes = cut(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"),
                                                          F.col("fp").alias("first_fp"))).alias("first")), "classes")
    roots = connected_components(links(classes.select("fp"), radius, bucket)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("low"))
    return rooted.join(least, "root").select("fp", F.col("low.doc_id").alias("component_id"), F.col("low.first_fp").alias("first_fp"))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Null texts are empty; empty texts share fingerprint zero and so one component; fewer words than a
    shingle count as one shingle; repeated rows give repeated results; rows with a null id belong to components but
    never name them unless alone; other columns are not read; an empty table gives an empty result."""
    prints = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), words).alias("fp")), "prints")
    return prints.join(components(prints, radius), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id (one, if that row is repeated)."""
    name = free_name(docs, "_fp")
    held = cut(docs.withColumn(name, fingerprints(F.col(text_col), words)), "held")
    prints = held.select(F.col(id_col).alias("doc_id"), F.col(name).alias("fp"))
    stay = components(prints, radius).filter("fp = first_fp").select("fp", F.col("component_id").alias("doc_id"))

    def keyed(df: DataFrame, id_: str, fp: str) -> DataFrame:
        # plain equal keys, so the join's partitioning also serves dropDuplicates and texts are shuffled once
        return df.withColumns({keys[0]: F.coalesce(F.col(id_).cast("string"), F.lit("")), keys[1]: F.col(id_).isNull(), keys[2]: F.col(fp)})

    keys = [free_name(docs, k) for k in ("_key_id", "_key_none", "_key_fp")]
    one = keyed(held, id_col, name).join(keyed(stay, "doc_id", "fp").select(*keys), keys, "left_semi")
    return one.dropDuplicates(keys).select(*(F.col(f"`{c}`") for c in docs.columns))
