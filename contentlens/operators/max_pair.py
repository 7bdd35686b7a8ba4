"""J7's maximum without all pairs: cells of vectors are paired best bound first, until no bound beats the best pair found.

Rows at angles [near, far] around their centre can be no closer to rows of another cell than the angle
between the centres less both radii.  The cells are multiplied with themselves first, which reads few blocks and finds a
high cosine; that drops every other pair of cells, and every row of them, whose bound lies below, and the rest is multiplied in one
wave.  Whatever the bounds prune, the value is that over all pairs.

Rows are packed once in the order of their cells (``blocks.py``), and every two blocks meet in a Cartesian join of the held table; a row
is multiplied only if its own angles leave a cell of the other block open.  Products are taken in single precision; only those that may beat the
best so far are computed in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import CHUNK, PACKED, STRIP, Block, Part, cosines, load, margin, meet, met_blocks, pack, with_more
from .cells import BLOCK, SLACK, CellIndex, _angles, build_cells
from .holding import hold

MAX_CELLS = 1024      # bound of the cells, so of the table of cell pairs (its square) that driver and tasks hold
FIRST_SHARE = 1 / 16  # share of all products that the first wave, of cells with themselves, may take
CELL_ROWS = 64        # rows a cell has on average, at least, unless the caller sets the cells
ONE = 1 - 1e-12       # no cosine is above 1 by more than rounding, so such a value ends the search


class MaxPair(NamedTuple):
    """``similarity``: greatest cosine of two rows (None below two rows); ``products``: row pairs of the cells multiplied, of ``pairs``."""
    similarity: float | None
    products: int
    pairs: int
    cells: int
    waves: int


def _cell_pairs(index: CellIndex, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, least angle, products) of the pairs a <= b of filled cells, closest first."""
    theta = _angles(index.centres, index.centres)
    near, far = index.near, index.far
    with np.errstate(invalid="ignore"):  # empty cells have infinite ends
        least = np.maximum(theta - far[:, None] - far[None, :],
                           np.maximum(near[:, None] - theta - far[None, :], near[None, :] - theta - far[:, None]))
    np.fill_diagonal(least, -2 * far)    # a centre's angle to itself is 0 but for rounding
    a, b = np.triu_indices(len(sizes))
    cost = np.where(a == b, sizes[a] * (sizes[a] - 1) // 2, sizes[a] * sizes[b])
    some = cost > 0
    a, b, cost = a[some], b[some], cost[some]
    order = np.lexsort((b, a, least[a, b]))
    return a[order], b[order], least[a, b][order], cost[order]


def _multiply(packed: DataFrame, index: CellIndex, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, best: float) -> float:
    """Greatest cosine of the packed rows over the cell pairs (a, b), at least ``best``."""
    centres, near, far = index.centres, index.near, index.far
    asked = np.zeros((len(sizes), len(sizes)), bool)
    asked[a, b] = asked[b, a] = True

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for number, packed in zip(pdf["blk"], pdf["pack"]):
                own = load(packed)
                home = own.more["cell"]
                angle = _angles(own.unit, centres)
                gap = np.maximum(0, np.maximum(angle - far, near - angle))
                hope = asked[home] & (np.cos(np.minimum(gap, np.pi)) + SLACK > best)
                hope[np.arange(len(home)), home] = asked[home, home]
                yield pd.DataFrame({"blk": [number], "pack": [with_more(packed, open=np.packbits(hope, axis=1))],
                                    "home": [np.unique(home)], "open": [np.flatnonzero(hope.any(0))]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = best
        for x, left, y, right in met_blocks(batches):
            i, j = (np.flatnonzero(_opened(side, len(sizes))[:, np.unique(other.more["cell"])].any(1))
                    for side, other in ((left, right), (right, left)))
            if not len(i) or not len(j):
                continue
            some = Part(right, j) if len(j) < len(right.ids) else right
            off = margin(left)
            for lo in range(0, len(i), STRIP):
                rows = i[lo:lo + STRIP]
                part = Part(left, rows)
                s = part.single @ some.single.T
                if x == y:
                    s[rows[:, None] >= j[None, :]] = -2  # each pair once, no row with itself
                high = float(s.max())  # of any pair, asked for or not: none is above the greatest
                if high <= -2 or high + off <= top:
                    continue
                p, q = np.divmod(np.flatnonzero(s >= np.float32(max(top, high - off) - 2 * off)), len(j))
                top = max(top, *(float(cosines(part, some, p[at:at + CHUNK], q[at:at + CHUNK]).max()) for at in range(0, len(p), CHUNK)))
        yield pa.RecordBatch.from_pydict({"best": pa.array([top], pa.float64())})

    opened = hold(packed.mapInPandas(route, PACKED + ", home array<long>, open array<long>"))
    opened.count()  # its measured size decides how it is joined
    met = meet(opened.withColumnsRenamed({"home": "home_a", "open": "open_a"}), opened, on=(
        (F.col("a") <= F.col("b")) & F.arrays_overlap("open_a", "home") & F.arrays_overlap("open", "home_a")))
    got = met.select("a", "pack_a", "b", "pack_b").mapInArrow(run, "best double").agg(F.max("best").alias("best")).first()
    opened.unpersist()
    return max(best, got["best"] if got["best"] is not None else best)


def _opened(b: Block, cells: int) -> np.ndarray:
    return np.unpackbits(b.more["open"], axis=1, count=cells).astype(bool)


def max_pair(v: DataFrame, cells: int | None = None, block: int = BLOCK, first_share: float = FIRST_SHARE) -> MaxPair:
    """The greatest cosine of two rows of ``v`` (``similarity.as_vectors``; ids are distinct); runs when called.

    A zero vector has cosine 0 with every other row.  ``cells`` is at most ``MAX_CELLS``, by default four times the root of the row count,
    with at least ``CELL_ROWS`` rows a cell."""
    v = hold(v)
    n = v.count()
    pairs = n * (n - 1) // 2
    if n < 2:
        return MaxPair(None, 0, 0, 0, 0)
    index = build_cells(v, min(MAX_CELLS, cells or math.ceil(min(4 * math.sqrt(n), n / CELL_ROWS))))
    sizes = np.zeros(len(index.centres), np.int64)
    for r in index.rows.filter("cell >= 0").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["cell"]] = r["n"]  # one row a centre
    best = 0.0 if sizes.sum() < n else -math.inf
    packed = pack(index.rows.filter("cell >= 0"), index.dim, int(sizes.sum()), block, by="cell", more=("cell",))
    a, b, least, cost = _cell_pairs(index, sizes)
    order = np.argsort(a != b, kind="stable")  # cells with themselves first
    a, b, least, cost = a[order], b[order], least[order], cost[order]
    hope = np.cos(np.clip(least, 0, np.pi)) + SLACK
    products, waves = 0, 0
    own = (a == b) & (np.cumsum(cost) <= max(1.0, pairs * first_share))
    for wave in (own, ~own):
        wave = wave & (hope > best)
        if wave.any() and best < ONE:
            best = _multiply(packed, index, sizes, a[wave], b[wave], best)
            products, waves = products + int(cost[wave].sum()), waves + 1
    return MaxPair(best, products, pairs, int((sizes > 0).sum()), waves)
