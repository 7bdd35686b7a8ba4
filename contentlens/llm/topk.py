"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are cut into segments at several resolutions; a segment keeps its mean and standard deviation.  For segments of
length l the squared distance of two vectors is at least the sum of l * ((mean difference)^2 + (deviation
difference)^2), and with known norms a lower bound of the distance is an upper bound of the inner product:
2 <x, y> = |x|^2 + |y|^2 - d^2, that is <x, y> <= sum of l * (mean * mean + deviation * deviation).
Bounds are one small matrix product a level.  Pairs whose bound is under the query's k-th best score so far
are dropped, coarse level first; survivors of the finest level get exact integer products.

Queries go through in blocks of bounded size, one broadcast each, so neither the driver nor a task holds
all of them; candidates are read where they lie and only k rows a query and task are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K = 5
SCALE = 256
QUERY_EVERY = 50
QUERY_BLOCK = 4096   # queries of one broadcast; with their statistics at most a few MB for 64 components
SEGMENTS = (2, 8, 32)   # segments a level, coarse to fine
ROWS = 4096             # candidates compared at once
SLACK = 1e-9            # of the norms, for rounding of the bounds


def _boundaries(size: int, segments: int) -> np.ndarray:
    return np.unique(np.linspace(0, size, min(segments, size) + 1).astype(int)[:-1])


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(l) * (means, deviations) of each row's segments, so that a dot product is the bound."""
    at = _boundaries(x.shape[1], segments)
    length = np.diff(np.append(at, x.shape[1]))
    mean = np.add.reduceat(x, at, axis=1) / length
    square = np.add.reduceat(x * x, at, axis=1) / length
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.concatenate((mean, deviation), axis=1) * np.sqrt(np.concatenate((length, length)))


class Block:
    """Queries of one vector length: ids, whole-number vectors, statistics by level."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.levels = [statistics(self.vectors.astype(float), s) for s in SEGMENTS]
        self.norms = np.sqrt((self.vectors.astype(float) ** 2).sum(1))


class Best:
    """The k best (score, id) of each query so far; ties to the smaller id."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.score = np.full((len(block.ids), 0), 0, np.int64)
        self.id = np.full((len(block.ids), 0), 0, np.int64)
        self.have = np.zeros((len(block.ids), 0), bool)

    def least(self) -> np.ndarray:
        """Score a candidate must reach (equal may win by its id); minus infinity while a query has room."""
        if self.score.shape[1] < self.k:
            return np.full(len(self.block.ids), -np.inf)
        return np.where(self.have[:, -1], self.score[:, -1].astype(float), -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        """Take in scored pairs: ranked with what is held, the first k of each query stay."""
        held_q, held_c = np.nonzero(self.have)
        q = np.concatenate((held_q, query))
        s = np.concatenate((self.score[held_q, held_c], score))
        i = np.concatenate((self.id[held_q, held_c], ident))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        stay = place < self.k
        q, s, i, place = q[stay], s[stay], i[stay], place[stay]
        shape = (len(self.block.ids), self.k)
        self.score, self.id, self.have = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)
        self.score[q, place], self.id[q, place], self.have[q, place] = s, i, True


def compare(best: Best, ids: np.ndarray, vectors: np.ndarray) -> int:
    """Compare a batch of candidates with a block's queries; returns the number of exact products."""
    block = best.block
    x = vectors.astype(float)
    need = best.least()
    slack = SLACK * np.outer(block.norms, np.sqrt((x * x).sum(1))) + 1e-6
    alive = block.ids[:, None] != ids[None, :]
    for level, segments in enumerate(SEGMENTS):
        if not np.isfinite(need).any():
            break
        of_x = statistics(x, segments)
        share = alive.mean()
        if share > 0.1:
            alive &= block.levels[level] @ of_x.T + slack >= need[:, None]
        else:  # few are left: bound those alone
            q, c = np.nonzero(alive)
            for lo in range(0, len(q), 1 << 16):
                a, b = q[lo:lo + (1 << 16)], c[lo:lo + (1 << 16)]
                bound = np.einsum("ij,ij->i", block.levels[level][a], of_x[b]) + slack[a, b]
                out = bound < need[a]
                alive[a[out], b[out]] = False
    q, c = np.nonzero(alive)
    scores = np.empty(len(q), np.int64)
    for lo in range(0, len(q), 1 << 16):
        a, b = q[lo:lo + (1 << 16)], c[lo:lo + (1 << 16)]
        scores[lo:lo + (1 << 16)] = np.einsum("ij,ij->i", block.vectors[a], vectors[b])
    good = scores >= need[q]
    best.add(q[good], scores[good], ids[c[good]])
    return len(q)


def whole_numbers(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<long>): floor(SCALE * x); vectors that are null or hold nulls or no finite numbers are left out."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(
        F.col("x").isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        "vec_id", F.transform("x", lambda e: F.floor(e * SCALE).cast("long")).alias("v"))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each vector length in a batch."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    ends = ends - ends[0]
    lengths = np.diff(ends)
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield ids[rows], flat[ends[rows][:, None] + np.arange(size)] if size else np.zeros((len(rows), 0), np.int64)


def top_k(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, block: int = QUERY_BLOCK,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query, ties to the smaller id.

    Queries are rows whose id is divisible by ``query_every``, candidates all rows of another id.  Vectors that are null, or
    hold nulls or non-finite numbers, and rows without an id take no part; only vectors of one length are compared;
    of repeated query ids the smallest vector asks; repeated candidates count each; other columns
    are not read; an empty table gives an empty result."""
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, id_col, vector_col)
    queries = cut(rows.filter(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n_blocks = max(1, -(-queries.count() // block))
    hits: DataFrame | None = None
    for b in range(n_blocks):
        part = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).toArrow()
        held = [Block(i, v) for chunk in part.to_batches() for i, v in _by_length(chunk)]
        merged = {}
        for x in held:  # Arrow may deliver several chunks
            merged.setdefault(x.vectors.shape[1], []).append(x)
        blocks = spark.sparkContext.broadcast({size: Block(np.concatenate([x.ids for x in xs]), np.concatenate([x.vectors for x in xs]))
                                               for size, xs in merged.items()})

        def search(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            best = {size: Best(x, k) for size, x in blocks.value.items()}
            for batch in batches:
                for ids, mat in _by_length(batch):
                    if mat.shape[1] not in best:
                        continue
                    step = max(64, ROWS * 1024 // max(1024, len(best[mat.shape[1]].block.ids)))
                    for lo in range(0, len(ids), step):
                        if mat.shape[1]:
                            compare(best[mat.shape[1]], ids[lo:lo + step], mat[lo:lo + step])
                        else:  # vectors without components: every product is 0
                            q, c = np.nonzero(best[0].block.ids[:, None] != ids[None, lo:lo + step])
                            best[0].add(q, np.zeros(len(q), np.int64), ids[lo:lo + step][c])
            for x in best.values():
                q, c = np.nonzero(x.have)
                yield pa.RecordBatch.from_arrays([pa.array(x.block.ids[q]), pa.array(x.id[q, c]), pa.array(x.score[q, c])],
                                                 ["query_id", "vec_id", "score"])

        # written before the next block is sent, so executors hold the vectors of one block at a time
        found = cut(rows.mapInArrow(search, "query_id long, vec_id long, score long"), "hits")
        blocks.destroy()
        hits = found if hits is None else hits.union(found)
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
