"""Vector similarity: J1-J8 on Spark.

Exact pair search by *blocks* (``blocks.py``): vectors are packed into rows of
at most ``block_size`` vectors, and every two packed rows meet once in a
Cartesian join that reads the held table, so a vector is shuffled once and not
once a block.  A task multiplies two blocks at a time and emits only the pairs
that pass the threshold; no task holds more than two blocks and its output, and
the candidate set is never materialised as rows.

Exact copies are collapsed first (``groupBy(vector)`` with map-side combine,
so a vector shared by a third of all rows costs one row per map task): the
pair search runs over *distinct* vectors and its result is reported as
representative pairs with their copy counts, plus one row per copy group.
That form is lossless — the reference's flat pair list is every member pair
across a matched pair of groups plus every member pair inside a group — and
its size does not grow quadratically with a hot group.  The pair count is
computed arithmetically from it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .holding import hold
from .stats import attach_scalars, top_k_per_group

PAIR_SCHEMA = "id_1 long, id_2 long, similarity double"
TOPK_SCHEMA = "qid long, id long, similarity double"


def _payload_cols(sparse: bool) -> list[str]:
    return ["indices", "values"] if sparse else ["vec"]


def as_vectors(df: DataFrame, id_col: str, vec_col: str | None = None,
               sparse: tuple[str, str] | None = None) -> DataFrame:
    """Normalise input to (id, vec) dense or (id, indices, values) sparse; drops null vectors."""
    if sparse:
        i, v = sparse
        out = df.select(F.col(id_col).cast("long").alias("id"), F.col(i).alias("indices"),
                        F.col(v).alias("values"))
        return out.filter(F.col("values").isNotNull())
    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    return out.filter(F.col("vec").isNotNull())


def _is_sparse(df: DataFrame) -> bool:
    return "indices" in df.columns


def _matrix(pdf: pd.DataFrame, sparse: bool, dim: int) -> np.ndarray:
    n = len(pdf)
    if sparse:
        m = np.zeros((n, dim), dtype=np.float64)
        sizes = [len(i) for i in pdf["indices"]]
        if sum(sizes):
            at = np.concatenate([np.asarray(i, dtype=np.int64) for i in pdf["indices"]])
            m[np.repeat(np.arange(n), sizes), at] = np.concatenate([np.asarray(x, dtype=np.float64) for x in pdf["values"]])
        return m
    return np.vstack([np.asarray(v, dtype=np.float64) for v in pdf["vec"]]) if n else np.zeros((0, dim))


def _unit_rows(pdf: pd.DataFrame, sparse: bool, dim: int) -> np.ndarray:
    m = _matrix(pdf, sparse, dim)
    norms = np.sqrt((m * m).sum(axis=1))
    safe = np.where(norms == 0, 1.0, norms)
    return m / safe[:, None]          # zero vectors stay zero: cosine 0 with everything


def _count_and_dim(df: DataFrame, sparse: bool, dim: int | None) -> tuple[int, int]:
    """One small job: row count and vector width (two scalars to the driver)."""
    if sparse:
        r = df.agg(F.count(F.lit(1)).alias("n"),
                   (F.coalesce(F.max(F.array_max("indices")), F.lit(-1)) + 1).alias("d")).first()
    else:
        r = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    return int(r["n"]), int(dim or r["d"] or 1)


def block_pairs(v: DataFrame, threshold: float | None, block_size: int = 2048,
                dim: int | None = None) -> DataFrame:
    """All pairs id_1 < id_2 with cosine > threshold (None: every pair)."""
    # Read twice (count and width, then the packing): keep it.
    return _block_pairs(hold(v), threshold, block_size, dim).select("id_1", "id_2", "similarity")


def _met_once(v: DataFrame, block_size: int, dim: int | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Every two blocks of a held table, one time."""
    from .blocks import meet, pack
    n, d = _count_and_dim(v, _is_sparse(v), dim)
    packed = pack(v, d, n, block_size, more=more)
    return meet(packed, packed, once=True)


def _block_pairs(v: DataFrame, threshold: float | None, block_size: int, dim: int | None = None,
                 copies: bool = False) -> DataFrame:
    """``block_pairs`` of a held table; with ``copies`` its column of that name goes along as copies_1 and copies_2."""
    from .blocks import close_pairs, met_blocks, strips, table
    t = -math.inf if threshold is None else float(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, left, b, right in met_blocks(batches):
            for lo, some in strips(left):
                i, j, s = close_pairs(some, right, t)
                past = s > t
                i += lo
                if a == b:
                    past &= left.ids[i] < right.ids[j]
                i, j, s = i[past], j[past], s[past]
                if not len(i):
                    continue
                x, y = left.ids[i], right.ids[j]
                out = {"id_1": np.minimum(x, y), "id_2": np.maximum(x, y), "similarity": s}
                if copies:
                    m, k = left.more["copies"][i], right.more["copies"][j]
                    out |= {"copies_1": np.where(x < y, m, k), "copies_2": np.where(x < y, k, m)}
                yield table(**out)

    return _met_once(v, block_size, dim, ("copies",) if copies else ()).mapInArrow(
        run, PAIR_SCHEMA + (", copies_1 long, copies_2 long" if copies else ""))


def _pair_totals(v: DataFrame, threshold: float, block_size: int) -> DataFrame:
    """(rep, pairs) of the pairs of a held table of distinct vectors: every row that is in a pair, with the number of flat pairs of which it is
    the smaller id.  A task gives at most one row for each row of its blocks."""
    from .blocks import met_blocks, past_pairs, strips, table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {}  # by block: ids, flat pairs (-1: in no pair)
        for a, left, b, right in met_blocks(batches):
            (x, of_x), (y, of_y) = (totals.setdefault(k, (side.ids, np.full(len(side.ids), -1, np.int64))) for k, side in ((a, left), (b, right)))
            for lo, some in strips(left):
                i, j = past_pairs(some, right, threshold)
                i += lo
                if a == b:
                    once = x[i] < y[j]
                    i, j = i[once], j[once]
                of_x[i], of_y[j] = np.maximum(of_x[i], 0), np.maximum(of_y[j], 0)
                w = left.more["copies"][i] * right.more["copies"][j]
                first = x[i] < y[j]
                np.add.at(of_x, i[first], w[first])
                np.add.at(of_y, j[~first], w[~first])
        for ids, n in totals.values():
            some = n >= 0
            if some.any():
                yield table(rep=ids[some], pairs=n[some])

    return _met_once(v, block_size, more=("copies",)).mapInArrow(run, "rep long, pairs long")


def _pair_bins(v: DataFrame, threshold: float, bins: int, top: float | None, block_size: int) -> DataFrame:
    """(similarity, pairs) of the pairs of a held table of distinct vectors, for ``stats.histogram`` with ``bins`` bins.

    Pairs that lie in one bin wherever its ends turn out to be are one row, with the similarity of one of them; the others,
    the least and the greatest are rows of their own.  The ends follow from the least and greatest of all pairs, which lie between ``threshold``
    and 1; what a task has met so far, and ``top`` (a similarity that another table adds), narrows them."""
    from .blocks import close_pairs, met_blocks, strips, table
    share, slack = np.arange(1, bins) / bins, 1e-12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = 1 + 1e-9, float(threshold) if top is None else top
        value, pairs = np.zeros(bins), np.zeros(bins, np.int64)
        for a, left, b, right in met_blocks(batches):
            for lo, some in strips(left):
                i, j, s = close_pairs(some, right, threshold)
                i += lo
                past = s > threshold
                if a == b:
                    past &= left.ids[i] < right.ids[j]
                i, j, s = i[past], j[past], s[past]
                if not len(s):
                    continue
                w = left.more["copies"][i] * right.more["copies"][j]
                own = np.zeros(len(s), bool)
                if s.min() < low:
                    low, own[s.argmin()] = s.min(), True
                if s.max() > high:
                    high, own[s.argmax()] = s.max(), True
                most = low + share * (1 + 1e-9 - low) + slack  # of the bins' lower ends
                least = threshold + share * (high - threshold) - slack
                of = np.searchsorted(most, s, "left")
                own |= of != np.searchsorted(least, s, "right")
                first = np.unique(of[~own], return_index=True)
                value[first[0]] = s[~own][first[1]]
                pairs += np.bincount(of[~own], weights=w[~own], minlength=bins).astype(np.int64)
                if own.any():
                    yield table(similarity=s[own], pairs=w[own])
        if pairs.any():
            yield table(similarity=value[pairs > 0], pairs=pairs[pairs > 0])

    return _met_once(v, block_size, more=("copies",)).mapInArrow(run, "similarity double, pairs long")


def similarity_matrix(v: DataFrame, block_size: int = 2048) -> DataFrame:
    """Long form (id_1 < id_2, similarity) of the whole matrix (quadratic by definition)."""
    return block_pairs(v, None, block_size)


def is_zero_vector(sparse: bool):
    if sparse:
        return F.coalesce(~F.exists("values", lambda x: x != 0), F.lit(True))
    return F.coalesce(~F.exists("vec", lambda x: x != 0), F.lit(True))


def collapse_copies(v: DataFrame) -> DataFrame:
    """One row per distinct vector: (rep = smallest id, copies, payload, is_zero)."""
    sparse = _is_sparse(v)
    cols = _payload_cols(sparse)
    g = v.groupBy(*cols).agg(F.min("id").alias("rep"), F.count(F.lit(1)).cast("long").alias("copies"))
    return g.withColumn("is_zero", is_zero_vector(sparse))


def duplicate_pairs(v: DataFrame, threshold: float = 0.80, empty_policy: str = "match",
                    block_size: int = 2048, recall: float | None = None, totals: bool = False,
                    bins: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate pairs (cosine strictly above ``threshold``), complete at every table size.

    Returns ``(pairs, copy_groups)``:
      pairs        id_1 < id_2 (representatives of distinct vectors), similarity
                   (unrounded), copies_1, copies_2;
      copy_groups  rep, copies (>= 2), is_zero, similarity (1.0) — identical
                   vectors; groups of empty (all-zero) vectors are kept when
                   ``empty_policy='match'`` (every empty text duplicates every
                   other, as the reference's encoder made them) and dropped
                   with ``'drop'``.
    ``copy_members`` names the rows of every group.

    With ``recall`` the pairs come from hashed candidates (``candidates.candidate_pairs``): below quadratic, each
    pair verified and found with that probability at least; without it every pair is found.

    Where only sums over the pairs are needed, they are formed in the tasks that find the pairs, and ``pairs`` grows with the rows, not with the
    pairs: with ``totals`` it is (rep, pairs), every representative of a pair with the number of flat pairs of which it is the smaller; with
    ``bins`` it is (similarity, pairs), of which ``stats.histogram`` with so many bins and the copy groups gives the counts of all pairs.
    """
    if empty_policy not in ("match", "drop"):
        raise ValueError("empty_policy must be 'match' or 'drop'")
    sparse = _is_sparse(v)
    # Read three times (block count, pair search, copy groups): keep it.
    groups = hold(collapse_copies(v))
    reps = groups.filter(~F.col("is_zero")).select(F.col("rep").alias("id"), *_payload_cols(sparse), "copies")
    keep = (F.col("copies") >= 2) & (~F.col("is_zero") | F.lit(empty_policy == "match"))
    copy_groups = groups.filter(keep).select("rep", "copies", "is_zero", F.lit(1.0).alias("similarity"))
    if totals:
        pairs = _pair_totals(reps, float(threshold), block_size)
    elif bins:
        pairs = _pair_bins(reps, float(threshold), bins, 1.0 if copy_groups.head(1) else None, block_size)
    elif recall is None:
        pairs = _block_pairs(reps, threshold, block_size, copies=True)
    else:
        from .candidates import candidate_pairs
        pairs = candidate_pairs(reps, threshold, recall)
    return pairs, copy_groups


def copy_members(v: DataFrame, copy_groups: DataFrame) -> DataFrame:
    """(rep, id) for every member of a copy group (linear in rows; a hot group is
    one key of an equi-join, split by AQE's skew handling)."""
    sparse = _is_sparse(v)
    groups = collapse_copies(v).select("rep", *_payload_cols(sparse))
    members = v.join(groups, _payload_cols(sparse)).select("rep", "id")
    return members.join(copy_groups.select("rep"), "rep", "left_semi")


def pair_count(pairs: DataFrame, copy_groups: DataFrame) -> DataFrame:
    """Number of pairs in the flat (reference) form, computed without expanding it; ``pairs`` may hold ``totals``."""
    flat = F.col("pairs") if "pairs" in pairs.columns else F.col("copies_1") * F.col("copies_2")
    a = pairs.agg(F.coalesce(F.sum(flat), F.lit(0)).alias("a"))
    b = copy_groups.agg(F.coalesce(F.sum(F.col("copies") * (F.col("copies") - 1) / 2), F.lit(0)).alias("b"))
    return attach_scalars(a, b).select((F.col("a") + F.col("b")).cast("long").alias("duplicate_pairs"))


def attach_metadata(pairs: DataFrame, meta: DataFrame, id_col: str = "id",
                    cols: tuple[str, ...] = ("url", "word_count")) -> DataFrame:
    """Url and word count of each pair side (two equi-joins on the row id)."""
    m = meta.select(F.col(id_col).alias("_id"), *cols)
    out = pairs
    for side in ("1", "2"):
        ren = m.select(F.col("_id").alias(f"id_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in cols])
        out = out.join(ren, f"id_{side}", "left")
    return out


def similar_pages(queries: DataFrame, corpus: DataFrame, k: int = 5, threshold: float = 0.70,
                  block_size: int = 2048, exclude_self: bool = False) -> DataFrame:
    """For every query vector, its ``k`` most similar corpus vectors with
    cosine >= threshold (rank 1 = most similar; ties by corpus id).  Similarities
    are compared at nine decimals, so copies tie.  ``exclude_self`` leaves out the
    corpus row of the query's own id.

    A task keeps the best ``k`` candidates of each query it meets, so the final
    per-query window sees at most ``k`` rows a query and partition of the corpus.
    Where ``queries`` is ``corpus`` itself, every two blocks are multiplied once, for the rows of both.
    """
    from .blocks import best_matches, meet, pack
    sparse, same = _is_sparse(queries), queries is corpus
    corpus = hold(corpus)
    nc, dc = _count_and_dim(corpus, sparse, None)
    if same:
        left = right = pack(corpus, dc, nc, block_size)
    else:
        queries = hold(queries)
        nq, dq = _count_and_dim(queries, sparse, None)
        left, right = (pack(v, max(dq, dc), n, block_size) for v, n in ((queries, nq), (corpus, nc)))
    t = float(threshold)
    cand = meet(left, right, once=same).mapInArrow(lambda batches: best_matches(batches, k, t, exclude_self, both=same), TOPK_SCHEMA)
    return top_k_per_group(cand, "qid", "similarity", k, "id")


def unit_sum_stats(v: DataFrame) -> DataFrame:
    """J7 mean without pairs: sum over i<j of cos(i, j) = (|sum u|^2 - sum |u|^2) / 2
    for unit vectors u (zero vectors contribute 0).  One row: n, pair_sum."""
    sparse = _is_sparse(v)
    if sparse:
        nrm = F.sqrt(F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        u = v.select("id", nrm.alias("nrm"), F.arrays_zip("indices", "values").alias("e"))
        ex = u.select("id", "nrm", F.inline("e")).select(
            F.col("indices").alias("pos"),
            F.when(F.col("nrm") > 0, F.col("values").cast("double") / F.col("nrm")).otherwise(0.0).alias("x"))
    else:
        nrm = V.norm("vec")
        u = v.select("id", nrm.alias("nrm"), "vec")
        ex = u.select("nrm", F.posexplode("vec")).select(
            "pos", F.when(F.col("nrm") > 0, F.col("col").cast("double") / F.col("nrm")).otherwise(0.0).alias("x"))
    per_dim = ex.groupBy("pos").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    tot = per_dim.agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"))
    n = v.agg(F.count(F.lit(1)).alias("n"))
    return attach_scalars(n, tot).select("n", ((F.col("ss") - F.col("qq")) / 2).alias("pair_sum"))


def upper_triangle_stats(v: DataFrame, block_size: int = 2048) -> DataFrame:
    """Mean and max of the off-diagonal similarities (i < j) over the whole table; runs when called.

    The mean needs no pairs (``unit_sum_stats``).  The maximum is 1 if two rows hold one non-zero vector; else
    it is searched best bound first (``max_pair``), over one row a distinct vector."""
    from .max_pair import max_pair
    v = hold(v)
    groups = hold(collapse_copies(v))
    shape = groups.agg(F.count(F.when(~F.col("is_zero") & (F.col("copies") > 1), 1)).alias("copied"),
                       F.sum("copies").alias("n"), F.sum(F.when(F.col("is_zero"), F.col("copies"))).alias("zeros")).first()
    if shape["copied"]:
        best = 1.0
    else:
        reps = groups.select(F.col("rep").alias("id"), *_payload_cols(_is_sparse(v)))
        best = max_pair(reps, block=block_size).similarity
        if (shape["zeros"] or 0) > 1:  # zero vectors among themselves
            best = max(0.0, best if best is not None else 0.0)
    n_pairs = F.col("n") * (F.col("n") - 1) / 2
    return unit_sum_stats(v).select(
        n_pairs.cast("long").alias("n_pairs"), (F.col("pair_sum") / F.nullif(n_pairs, F.lit(0.0))).alias("mean_similarity"),
        F.lit(best).cast("double").alias("max_similarity"))
