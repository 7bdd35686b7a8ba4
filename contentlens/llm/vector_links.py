"""Embedding near-duplicates: exact range join in the metric space of angles.

A sample of the vectors serves as pivots; every vector lives in the cell of its nearest pivot.  Vectors u and v within
the radius r (the angle of the least cosine) whose homes are cells p and q meet in one of the two cells, by the parity of p + q,
where the other vector is a replica.  A replica is sent only where the triangle inequality allows a partner: its angle to the
other pivot is at most 2 r more than to its own, and within r of the angles of that cell's members; the bisector of the two
pivots, a great circle, must be within r too.  So no pair is lost and none is met twice, and cells join on their own.

Equal vectors are collapsed first.  A cell above ``BLOCK`` vectors is joined in pairs of blocks, so no task holds more than two.
A task returns one row a linked vector (its number of partners there, and one partner of its part), never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut

LEAST_COSINE = 0.95
CELL = 8192                 # vectors a pivot stands for
PIVOT_BYTES = 16 << 20      # bound of all pivots as doubles, which every task holds
BLOCK = 8192                # vectors of one side of a task
ROWS = 512                  # rows of a block compared at once
HOT = 1000                  # vectors held by more than one row in HOT go by broadcast; they are fewer than HOT
SLACK = 1e-9                # of cosines and angles, for rounding of the bounds


def unit_rows(flat: np.ndarray, size: int) -> np.ndarray:
    """Vectors of length 1 in double precision; scaled first, so that no square overflows or vanishes."""
    x = flat.astype(float).reshape(-1, size)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_size(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) for each vector length of a column."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    ends = ends - ends[0]
    sizes = np.diff(ends)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, unit_rows(flat[ends[rows][:, None] + np.arange(size)], int(size))


class Pivots:
    """Pivots by vector length, their numbers, and the least and greatest angle of each cell's members."""

    def __init__(self, by_size: dict[int, np.ndarray], radius: float):
        self.radius, self.by_size, self.first, total = radius, by_size, {}, 0
        for size, p in sorted(by_size.items()):
            self.first[size] = total
            total += len(p)
        self.nearest, self.farthest = np.full(total, np.inf), np.full(total, -np.inf)

    def homes(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cosines with all pivots, number of the nearest within this length, angle to it)."""
        cos = u @ self.by_size[u.shape[1]].T
        home = cos.argmax(1)
        return cos, home, np.arccos(np.clip(cos[np.arange(len(u)), home], -1, 1))

    def replicas(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home of each row, rows of replicas, cells they go to), cells by their numbers."""
        size, r = u.shape[1], self.radius
        p, first = self.by_size[size], self.first[size]
        cos, home, at_home = self.homes(u)
        angle = np.arccos(np.clip(cos, -1, 1))
        cells = np.arange(len(p))
        near, far = self.nearest[first:first + len(p)], self.farthest[first:first + len(p)]
        go = (angle <= at_home[:, None] + 2 * r + SLACK) & (angle <= far + r + SLACK) & (angle >= near - r - SLACK)
        apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))  # a bisector's distance from u is asin((cos p - cos q) / |p - q|)
        go &= cos[np.arange(len(u)), home][:, None] - cos <= apart[home] * sin(min(r, np.pi / 2)) + SLACK
        other = home[:, None] + cells
        go &= np.where(other % 2 == 1, cells < home[:, None], cells > home[:, None])  # each two cells meet in one of them
        row, cell = np.nonzero(go)
        return home + first, row, cell + first


def choose_pivots(distinct: DataFrame, radius: float, cell: int = CELL) -> Pivots:
    """Of each vector length one pivot a ``cell`` vectors, those of least hash, bounded by ``PIVOT_BYTES`` in all."""
    sizes = {r["size"]: r["n"] for r in distinct.groupBy("size").agg(F.count("*").alias("n")).collect()}
    total = sum(size * 8 * ceil(n / cell) for size, n in sizes.items())
    share = min(1.0, PIVOT_BYTES / max(1, total))
    found = {}
    for size, n in sizes.items():  # few lengths; usually one
        k = max(1, int(ceil(n / cell) * share))
        rows = distinct.filter(F.col("size") == size).orderBy(F.xxhash64("x"), "node").limit(k).select("x").toArrow()
        found[size] = np.concatenate([u for c in rows.column(0).chunks for _, u in _by_size(c)])
    return Pivots(found, radius)


def _batches(columns: list[str], rows) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], columns)


def cell_spans(distinct: DataFrame, pivots: Pivots) -> None:
    """Fill in the angles of each cell's members: one partially aggregated row a cell."""
    def run(batches):
        for b in batches:
            for _, u in _by_size(b.column(0)):
                _, home, angle = pivots.homes(u)
                yield from _batches(["cell", "angle"], (home + pivots.first[u.shape[1]], angle))

    spans = distinct.select("x").mapInArrow(run, "cell long, angle double").groupBy("cell").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"))
    for r in spans.collect():  # one row a pivot
        pivots.nearest[r["cell"]], pivots.farthest[r["cell"]] = r["low"], r["high"]


def members(distinct: DataFrame, pivots: Pivots) -> DataFrame:
    """(cell, replica, node, copies, x): every vector in its home cell and in the cells where a partner may live."""
    def run(batches):
        for b in batches:
            for rows, u in _by_size(b.column("x")):
                home, row, cell = pivots.replicas(u)
                take = pa.array(np.concatenate((rows, rows[row])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((home, cell))), pa.array(np.arange(len(take)) >= len(rows)),
                     b.column("node").take(take), b.column("copies").take(take), b.column("x").take(take)],
                    ["cell", "replica", "node", "copies", "x"])

    element = distinct.schema["x"].dataType.simpleString()
    return distinct.select("node", "copies", "x").mapInArrow(run, f"cell long, replica boolean, node long, copies long, x {element}")


def join_blocks(left: np.ndarray, right: np.ndarray | None, copies: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(partners of each vector, label of its linked part: the least position in it) of two blocks or one.

    Positions and ``copies`` run over left, then right.  Without ``right`` the block is joined with itself."""
    other = left if right is None else right
    shift = 0 if right is None else len(left)
    n = len(left) + (0 if right is None else len(right))
    partners, label = np.zeros(n, np.int64), np.arange(n)
    for lo in range(0, len(left), ROWS):
        hit = left[lo:lo + ROWS] @ other.T >= least
        if right is None:
            hit[np.arange(len(hit)), lo + np.arange(len(hit))] = False
        if not hit.any():
            continue
        partners[lo:lo + len(hit)] += hit @ copies[shift:shift + len(other)]
        if right is not None:
            partners[shift:] += copies[lo:lo + len(hit)] @ hit
        for i in np.flatnonzero(hit.any(1)):
            met = label[shift + np.flatnonzero(hit[i])]
            mine = label[lo + i]
            if met.min() != mine or met.max() != mine:  # parts merge, at most n - 1 times in all
                parts = np.unique(np.append(met, mine))
                label[np.isin(label, parts)] = parts[0]
    return partners, label


def links(distinct: DataFrame, least: float = LEAST_COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(node, partners, with_node): for each linked vector of each task its partners there and the first vector of its part."""
    pivots = choose_pivots(distinct, acos(max(-1.0, min(1.0, least))), cell)
    cell_spans(distinct, pivots)
    placed = members(distinct, pivots)
    held: dict[int, list[int]] = {}
    for r in placed.groupBy("cell", "replica").agg(F.count("*").alias("n")).collect():  # two rows a pivot
        held.setdefault(r["cell"], [0, 0])[r["replica"]] = ceil(r["n"] / block)
    blocks = distinct.sparkSession.createDataFrame(
        pa.table({"cell": list(held), "homes": [h for h, _ in held.values()], "visitors": [v for _, v in held.values()]},
                 pa.schema([("cell", pa.int64()), ("homes", pa.int64()), ("visitors", pa.int64())])))
    placed = placed.join(F.broadcast(blocks), "cell")
    at = F.pmod(F.xxhash64("node"), F.when(F.col("replica"), F.col("visitors")).otherwise(F.col("homes")))
    placed = placed.withColumn("at", at)
    # a home block meets itself, every later home block and every block of visitors (numbered after the homes)
    one = F.lit(1).cast("long")
    as_left = F.transform(F.sequence(F.col("at"), F.col("homes") + F.col("visitors") - one), lambda j: F.struct(
        F.col("at").alias("a"), j.alias("b"), F.lit(True).alias("left")))
    earlier = F.when(F.col("replica"), F.col("homes")).otherwise(F.col("at"))
    as_right = F.when(earlier > 0, F.transform(F.sequence(F.lit(0).cast("long"), earlier - one), lambda i: F.struct(
        i.alias("a"), (F.col("at") + F.when(F.col("replica"), F.col("homes")).otherwise(F.lit(0))).alias("b"), F.lit(False).alias("left"))))
    both = F.when(F.col("replica"), as_right).otherwise(F.concat(as_left, F.coalesce(as_right, F.array())))
    routed = placed.select("cell", "node", "copies", "x", F.inline(both))

    def run(group: pa.Table) -> pa.Table:
        left = group.column("left").to_numpy()
        order = np.flatnonzero(left), np.flatnonzero(~left)
        alone = group.column("a")[0].as_py() == group.column("b")[0].as_py()
        node = np.concatenate([group.column("node").to_numpy()[o] for o in order])
        copies = np.concatenate([group.column("copies").to_numpy()[o] for o in order])
        x = group.column("x").combine_chunks()
        if isinstance(x, pa.ChunkedArray):
            x = x.chunk(0)
        (_, u), = _by_size(x)  # a cell is of one length
        if alone or not len(order[1]):
            partners, label = join_blocks(u, None, copies, least) if alone else (np.zeros(len(node), int), np.arange(len(node)))
        else:
            partners, label = join_blocks(u[order[0]], u[order[1]], copies, least)
        some = partners > 0
        return pa.table({"node": node[some], "partners": partners[some], "with_node": node[label[some]]})

    return routed.groupBy("cell", "a", "b").applyInArrow(run, "node long, partners long, with_node long")


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, cell: int = CELL, block: int = BLOCK,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    ``n_links`` counts the other rows of cosine ``least`` or more; ``component_id`` is the smallest id reachable by links; the row
    of that id is kept.  Vectors that are null, zero, empty or hold null or non-finite components link with nothing, nor do
    vectors of different lengths.  Repeated rows are rows of their own and link with each other.  A row without an id takes part, but names
    its component (null) only if no row there has an id.  Other columns are not read; an empty table gives an empty result."""
    x = F.col(vector_col)
    if vectors.schema[vector_col].dataType.simpleString() not in ("array<float>", "array<double>"):
        x = x.cast("array<double>")
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    usable = F.coalesce(~bad & F.exists("x", lambda e: e != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).withColumn("usable", usable)
    good = rows.filter("usable").select("vec_id", "x")
    distinct = cut(good.groupBy("x").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")).withColumn(
        "node", F.monotonically_increasing_id()).withColumn("size", F.size("x")), "vectors")
    found = cut(links(distinct, least, cell, block), "links")
    rooted = connected_components(found.filter("node <> with_node").select(F.col("node").alias("a"), F.col("with_node").alias("b")))
    counts = found.groupBy("node").agg(F.sum("partners").alias("partners"))
    known = (distinct.join(counts, "node", "left").join(rooted, "node", "left")
             .select("x", "vec_id", "copies", (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
                     F.coalesce("root", "node").alias("root")))
    known = cut(known, "known")
    # linked vectors only: the rest are their own components
    low = known.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    known = known.join(low, "root").select("x", "copies", "n_links", "component_id")
    total = distinct.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    often = F.col("copies") > max(1, total // HOT)
    hot = cut(known.filter(often), "hot")  # fewer than HOT rows
    answer = ["vec_id", "n_links", "component_id"]
    of_hot = good.join(F.broadcast(hot), "x").select(*answer)
    of_rest = good.join(F.broadcast(hot.select("x")), "x", "left_anti").join(known.filter(~often), "x").select(*answer)
    lone = rows.filter("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return of_hot.union(of_rest).union(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
    WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""
