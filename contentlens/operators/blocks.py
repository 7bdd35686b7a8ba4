"""Blocks of packed vectors and their products, without a shuffle that grows with the number of pairs.

``pack`` puts the vectors of a table, ordered by id, into rows of at most ``block`` vectors (one binary a row).  ``meet``
pairs the rows of two packed tables by a Cartesian join: a task reads one partition of each side from the held tables, so no vector
is copied to disk once for every block it meets.  What is shuffled, held and spilled is one copy of the vectors.

``close_pairs`` finds the pairs past a threshold by a product in single precision and verifies them in double
precision; the margin is the rounding error that such a product can have at most, so no pair is lost.  ``past_pairs``
verifies only what lies within that margin, for callers that need no cosine.

A task holds one block of each side, ``STRIP`` rows of their product at a time and the pairs of that strip, whatever share of the pairs is close.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .holding import hold

BLOCK = 2048       # vectors of a packed row
PARTITIONS = 12    # of a packed table, unless that makes more than ROWS rows a partition: a join of two has their product
ROWS = 16          # packed rows of a partition, which a task of the join holds
STRIP = 512        # rows of a product at a time
CHUNK = 8192       # pairs verified at a time
PACKED = "blk long, pack binary"


class Block:
    """Vectors of a packed row: ids, unit rows (zero vectors stay zero) in both precisions, further columns by name."""

    def __init__(self, ids: np.ndarray, shape: tuple[int, int], places: np.ndarray, values: np.ndarray, more: dict[str, np.ndarray]):
        self.ids, self.shape, self.more, self._places, self._values = ids, shape, more, places, values

    def _filled(self, kind: type) -> np.ndarray:
        m = np.zeros(self.shape, kind)
        m.reshape(-1)[self._places] = self._values
        return m

    @cached_property
    def unit(self) -> np.ndarray:
        return self._filled(np.float64)

    @cached_property
    def single(self) -> np.ndarray:
        return self._filled(np.float32)


class Part:
    """Some rows of a block."""

    def __init__(self, b: Block, rows: np.ndarray | slice):
        self.ids, self.single, self._block, self._rows = b.ids[rows], b.single[rows], b, rows

    @cached_property
    def unit(self) -> np.ndarray:
        return self._block.unit[self._rows]


def _packed(ids: np.ndarray, m: np.ndarray, kind: np.dtype, more: dict[str, np.ndarray]) -> bytes:
    filled = m != 0
    counts = filled.sum(1).astype(np.int32)
    at = np.nonzero(filled)[1].astype(np.uint16 if m.shape[1] <= 1 << 16 else np.int32)
    norms = np.sqrt((m * m).sum(1))
    return pickle.dumps((ids, m.shape, counts, at, m[filled].astype(kind), norms, more), protocol=5)


def load(pack: bytes) -> Block:
    ids, shape, counts, at, values, norms, more = pickle.loads(pack)
    rows = np.repeat(np.arange(shape[0]), counts)
    return Block(ids, shape, rows * shape[1] + at, values / norms[rows], more)


def with_more(pack: bytes, **more: np.ndarray) -> bytes:
    """A packed row with further columns."""
    *rest, had = pickle.loads(pack)
    return pickle.dumps((*rest, had | more), protocol=5)


def pack(v: DataFrame, dim: int, n: int, block: int = BLOCK, by: str = "id", more: tuple[str, ...] = (),
         rows: int = ROWS) -> DataFrame:
    """(blk, pack): the ``n`` vectors of ``v`` in rows of at most ``block``, held; ``more`` names columns that go along,
    ``rows`` bounds the packed rows of a partition.

    One shuffle deals the rows by ``by`` and sorts them, so a lost partition comes back with the same blocks."""
    from .similarity import _is_sparse, _matrix
    sparse = _is_sparse(v)
    values = v.schema["values" if sparse else "vec"].dataType.elementType
    kind = np.float32 if isinstance(values, T.FloatType) else np.float64
    count = math.ceil(n / block)
    parts = max(1, min(PARTITIONS, count), math.ceil(count / rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            while len(rest) >= block:
                yield row(number, rest.iloc[:block])
                rest, number = rest.iloc[block:], number + 1
        if rest is not None and len(rest):
            yield row(number, rest)

    def row(number: int, pdf: pd.DataFrame) -> pd.DataFrame:
        along = {c: pdf[c].to_numpy() for c in more}
        return pd.DataFrame({"blk": [number], "pack": [_packed(pdf["id"].to_numpy(), _matrix(pdf, sparse, dim), kind, along)]})

    dealt = v.repartition(parts, by) if by == "id" else v.repartitionByRange(parts, by, "id")
    packed = hold(dealt.sortWithinPartitions(by, "id").mapInPandas(run, PACKED))
    packed.count()  # its measured size decides how it is joined
    return packed


def meet(left: DataFrame, right: DataFrame, once: bool = False, on: Column | None = None) -> DataFrame:
    """Every packed row of ``left`` with every one of ``right``; ``once``: of a table with itself, each two rows one time; ``on``: a
    condition on their further columns."""
    a = left.withColumnsRenamed({"blk": "a", "pack": "pack_a"})
    b = right.withColumnsRenamed({"blk": "b", "pack": "pack_b"})
    if on is not None:
        return a.join(b, on)
    return a.join(b, F.col("a") <= F.col("b")) if once else a.crossJoin(b)


def met_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block, int, Block]]:
    """(number, left block, number, right block) of the rows that ``meet`` gives; a block met twice in a row is read once."""
    last, left = None, None
    for batch in batches:
        a, pack_a, b, pack_b = (batch.column(c) for c in ("a", "pack_a", "b", "pack_b"))
        for k in range(batch.num_rows):
            if a[k].as_py() != last:
                last, left = a[k].as_py(), load(pack_a[k].as_buffer())
            yield last, left, b[k].as_py(), load(pack_b[k].as_buffer())


def table(**columns: np.ndarray) -> pa.RecordBatch:
    """What a task of ``mapInArrow`` gives back: whole numbers (ids may be null) but for ``similarity``."""
    return pa.RecordBatch.from_pydict({c: pa.array(x) if c == "similarity" else pa.array(x, from_pandas=True).cast(pa.int64())
                                       for c, x in columns.items()})


def strips(a: Block, rows: int = STRIP) -> Iterator[tuple[int, Part]]:
    """(first row, rows) of a block, at most ``rows`` at a time."""
    for lo in range(0, len(a.ids), rows):
        yield lo, Part(a, slice(lo, lo + rows))


def margin(a: Block | Part) -> float:
    """What the product of two unit rows in single precision can be off, with room to spare."""
    return 2 * (a.single.shape[1] + 4) * 2.0 ** -24


def cosines(a: Block | Part, b: Block | Part, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of rows ``i`` of ``a`` with rows ``j`` of ``b`` in double precision."""
    return np.concatenate([np.einsum("ij,ij->i", a.unit[i[lo:lo + CHUNK]], b.unit[j[lo:lo + CHUNK]])
                           for lo in range(0, len(i), CHUNK)] or [np.zeros(0)])


def close_pairs(a: Block | Part, b: Block | Part, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of the rows of two blocks whose cosine, in double precision, is ``threshold`` or more."""
    n = len(b.ids)
    if math.isfinite(threshold):
        found = np.flatnonzero(a.single @ b.single.T >= threshold - margin(a))
        if 8 * len(found) <= len(a.ids) * n:
            i, j = np.divmod(found, n)
            s = cosines(a, b, i, j)
            past = s >= threshold
            return i[past], j[past], s[past]
    s = (a.unit @ b.unit.T).ravel()
    found = np.flatnonzero(s >= threshold)
    return *np.divmod(found, n), s[found]


def past_pairs(a: Block | Part, b: Block | Part, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the rows of two blocks whose cosine, in double precision, is above ``threshold``."""
    s, off = (a.single @ b.single.T).ravel(), margin(a)
    found = np.flatnonzero(s >= threshold - off)
    i, j = np.divmod(found, len(b.ids))
    near = np.flatnonzero(s[found] <= threshold + off)
    past = np.ones(len(found), bool)
    past[near] = cosines(a, b, i[near], j[near]) > threshold
    return i[past], j[past]


class Best:
    """The best ``k`` rows found for each row of a block, and ``least``: the cosine that a further one must reach."""

    def __init__(self, ids: np.ndarray, k: int, threshold: float):
        self.ids, self.k, self.least = ids, k, np.full(len(ids), threshold)
        self.at, self.found, self.sim = np.zeros(0, np.int64), ids[:0], np.zeros(0)

    def add(self, at: np.ndarray, found: np.ndarray, sim: np.ndarray) -> None:
        some = sim >= self.least[at]
        if not some.any():
            return
        at, found, sim = np.append(self.at, at[some]), np.append(self.found, found[some]), np.append(self.sim, sim[some])
        order = np.lexsort((found, -sim, at))
        at, found, sim = at[order], found[order], sim[order]
        place = np.arange(len(at)) - np.searchsorted(at, at, "left")
        last = place == self.k - 1
        self.least[at[last]] = sim[last]
        best = place < self.k
        self.at, self.found, self.sim = at[best], found[best], sim[best]


def best_matches(batches: Iterator[pa.RecordBatch], k: int, threshold: float, exclude_self: bool, digits: int = 9,
                 visits: bool = False, both: bool = False) -> Iterator[pa.RecordBatch]:
    """(qid, id, similarity): of the blocks that ``meet`` gives, each query's best ``k`` rows of the partition at ``threshold`` or more.

    Cosines are compared at ``digits`` decimals, ties by id.  With ``visits`` a query reads only rows of the cells (their column
    ``cell``) that its column ``cells`` lists or the bits of its column ``open`` name.  ``both``: the blocks are of one table, each two met
    once, and the rows of either are queries."""
    best = {}  # by block of queries: at most k candidates a row of the block
    last, seen = None, None
    for a, q, b, c in met_blocks(batches):
        rows, cols, reads = np.arange(len(q.ids)), np.arange(len(c.ids)), None
        if visits:
            if a != last:
                last, seen = a, _seen(q.more)
            cells = c.more["cell"]
            reads = np.zeros((len(rows), len(cols)), bool)
            inside = cells < seen.shape[1]
            reads[:, inside] = seen[:, cells[inside]]
            rows, cols = np.flatnonzero(reads.any(1)), np.flatnonzero(reads.any(0))
            if not len(rows):
                continue
        mine = best.setdefault(a, Best(q.ids, k, threshold))
        theirs = best.setdefault(b, Best(c.ids, k, threshold)) if both and a != b else None
        right = Part(c, cols) if len(cols) < len(c.ids) else c
        for lo in range(0, len(rows), STRIP):
            at = rows[lo:lo + STRIP]
            left = Part(q, at)
            least = mine.least[at][:, None]
            if theirs is not None:
                least = np.minimum(least, theirs.least[cols][None, :])
            least = least - 10.0 ** -digits
            found = np.flatnonzero(left.single @ right.single.T >= (least - margin(q)).astype(np.float32))
            if 8 * len(found) <= len(at) * len(cols):
                i, j = np.divmod(found, len(cols))
                sim = cosines(left, right, i, j)
            else:
                sim = left.unit @ right.unit.T
                found = np.flatnonzero(sim >= least)
                i, j = np.divmod(found, len(cols))
                sim = sim[i, j]
            i, j, sim = at[i], cols[j], np.round(sim, digits)
            past = sim >= threshold
            if reads is not None:
                past &= reads[i, j]
            if exclude_self:
                past &= q.ids[i] != c.ids[j]
            i, j, sim = i[past], j[past], sim[past]
            mine.add(i, c.ids[j], sim)
            if theirs is not None:
                theirs.add(j, q.ids[i], sim)
    for x in best.values():
        yield table(qid=x.ids[x.at], id=x.found, similarity=x.sim)


def _seen(more: dict[str, np.ndarray]) -> np.ndarray:
    """Which cells (columns) each row visits."""
    if "open" in more:
        return np.unpackbits(more["open"], axis=1).astype(bool)
    cells = more["cells"]
    size = [len(x) for x in cells]
    flat = np.concatenate([np.asarray(x, np.int64) for x in cells]) if sum(size) else np.zeros(0, np.int64)
    out = np.zeros((len(cells), int(flat.max()) + 1 if len(flat) else 0), bool)
    out[np.repeat(np.arange(len(cells)), size), flat] = True
    return out
