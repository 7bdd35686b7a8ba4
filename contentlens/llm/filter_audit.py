"""Filter interaction audit: what each of several document filters removes, in every order of applying them.

One finite-state pass over the UTF-8 bytes of a text measures it.  The transducer has two states (between words, in a
word); a table of 2 x 256 entries gives the output of each state and byte: word starts, word ends, capital, symbol, code point.
The state after a byte follows from that byte alone, so all transitions of a batch are looked up at once.  Word
spans go into an open-addressing hash table of (document, word); a hit counts only after the words' bytes are compared,
so equal hashes of different words do no harm.

A document's failed filters make a bit mask.  Counts per part and mask hold all that any order can show: a filter at a
step removes what fails it and no earlier one.  The rule on copies needs no join of the texts: of each digest the rows of the smallest id
are found by a partially aggregated minimum, and all others are counted as later copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from hashlib import sha256
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

COPY = "later_copy"
#: Failure conditions over the measures of a document; ``later_copy``: identical to the text of a smaller id.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 3 * n_chars",
    "D": "n_symbols > 0",
    "E": COPY,
}
MEASURES = ("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols")
CHUNK = 1 << 20      # bytes of text measured at once; a longer text is a chunk of its own
LONG_WORD = 256      # bytes from which a word is hashed and compared on its own

GAP, IN_WORD = 0, 1
STARTS, ENDS, CAPITAL, SYMBOL, FOLLOWS = 1, 2, 4, 8, 16   # outputs; FOLLOWS: continues a code point


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state of each byte, output of 256 * state + byte)."""
    byte = np.arange(256)
    space = (byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D))
    of_byte = (CAPITAL * ((byte >= 0x41) & (byte <= 0x5A)) + SYMBOL * np.isin(byte, list(b"#$%&*|"))
               + FOLLOWS * ((byte & 0xC0) == 0x80))
    out = np.concatenate((of_byte + STARTS * ~space, of_byte + ENDS * space))
    return np.where(space, GAP, IN_WORD).astype(np.uint16), out.astype(np.uint8)


NEXT, OUTPUT = transducer()
_M1, _M2, _M3 = (np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Words:
    """Word spans of a buffer, compared by their bytes."""

    def __init__(self, buffer: bytes, start: np.ndarray, end: np.ndarray, owner: np.ndarray):
        """``owner``: the document of each span.  The buffer has 8 spare bytes at its end."""
        self.buffer, self.start, self.length, self.owner = buffer, start, end - start, owner
        self.at = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))  # 8 bytes from any offset
        short = np.minimum(self.length, 8)
        self.head = self.at[start] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - short) * 8).astype(np.uint64))
        self.tail = self.at[np.maximum(end - 8, 0)]  # counts only from 8 bytes on
        self.tail[self.length <= 8] = 0

    def _middles(self, of: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """(spans, k): those that have an 8-byte piece k between head and tail, up to ``LONG_WORD``."""
        k = 1
        while True:
            of = of[(self.length[of] > 8 * k + 8) & (self.length[of] <= LONG_WORD)]
            if not len(of):
                return
            yield of, k
            k += 1

    def _bytes(self, i: int) -> bytes:
        return self.buffer[self.start[i]:self.start[i] + self.length[i]]

    def hashes(self) -> np.ndarray:
        h = (self.head * _M1) ^ (self.owner.astype(np.uint64) * _M3) ^ self.length.astype(np.uint64)
        h ^= h >> np.uint64(29)
        h = (h ^ self.tail) * _M2
        for of, k in self._middles(np.arange(len(h))):
            h[of] = (h[of] ^ (h[of] >> np.uint64(31)) ^ self.at[self.start[of] + 8 * k]) * _M1
        for i in np.flatnonzero(self.length > LONG_WORD):
            h[i] ^= np.uint64(xxhash.xxh64_intdigest(self._bytes(i)))
        return h ^ (h >> np.uint64(32))

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans a[i] and b[i] are of one document and hold the same bytes."""
        same = ((self.head[a] == self.head[b]) & (self.length[a] == self.length[b]) & (self.tail[a] == self.tail[b])
                & (self.owner[a] == self.owner[b]))
        rest = np.flatnonzero(same & (self.length[a] > 16) & (a != b))
        if len(rest):
            differs = np.zeros(len(a), bool)
            live = rest[self.length[a[rest]] <= LONG_WORD]
            k = 1
            while len(live):
                live = live[self.length[a[live]] > 8 * k + 8]
                unlike = self.at[self.start[a[live]] + 8 * k] != self.at[self.start[b[live]] + 8 * k]
                differs[live[unlike]] = True
                live = live[~unlike]
                k += 1
            for i in rest[self.length[a[rest]] > LONG_WORD]:
                differs[i] = self._bytes(a[i]) != self._bytes(b[i])
            same &= ~differs
        return same


def first_of_each(words: Words, hashes: np.ndarray | None = None) -> np.ndarray:
    """One span of every distinct (document, word): those that own a slot of the verified hash table."""
    h = words.hashes() if hashes is None else hashes
    n = len(h)
    size = 1 << max(4, int(2 * n).bit_length())
    table = np.full(size, -1, np.int64)
    slot = (h & np.uint64(size - 1)).astype(np.int64)
    step = ((h >> np.uint64(40)).astype(np.int64) << 1) | 1  # odd, so a probe sees every slot
    owns = np.zeros(n, bool)
    todo = np.arange(n)
    while len(todo):
        at = slot[todo]
        empty = table[at] < 0
        table[at[empty]] = todo[empty]  # of several claimants one stays
        holder = table[at]
        mine = holder == todo
        owns[todo[mine]] = True
        placed = mine | words.equal(todo, holder)
        todo = todo[~placed]
        slot[todo] = (slot[todo] + step[todo]) & (size - 1)
    return np.flatnonzero(owns)


def measure(texts: list[bytes]) -> np.ndarray:
    """One row of ``MEASURES`` for each text (UTF-8)."""
    buffer = b" ".join(texts) + b" " * 9  # a blank between texts brings the transducer back to its first state
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    data = np.frombuffer(buffer, np.uint8)[:int(begin[-1] + sizes[-1] + 1)]
    index = NEXT[data]
    index[1:] = index[:-1] << 8
    index[0] = GAP
    index |= data
    out = OUTPUT[index]

    def per_text(flag: int) -> np.ndarray:
        at = np.flatnonzero(out & flag)
        return np.bincount(np.searchsorted(begin, at, "right") - 1, minlength=len(texts))

    start, end = np.flatnonzero(out & STARTS), np.flatnonzero(out & ENDS)
    owner = np.searchsorted(begin, start, "right") - 1
    first = first_of_each(Words(buffer, start, end, owner)) if len(start) else np.zeros(0, np.int64)
    return np.stack((np.bincount(owner, minlength=len(texts)), np.bincount(owner[first], minlength=len(texts)),
                     per_text(CAPITAL), sizes - per_text(FOLLOWS), per_text(SYMBOL)), axis=1).astype(np.int64)


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > CHUNK:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def measured(docs: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part, the ``MEASURES`` and the digest (SHA-256) of every whole text; null texts are empty, null parts ''."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                         F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    schema = T.StructType([source.schema["doc_id"], source.schema["part"], *(T.StructField(m, T.LongType()) for m in MEASURES),
                           T.StructField("digest", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            if texts:
                found = np.concatenate([measure(c) for c in _chunks(texts)])
                digest = pa.array([sha256(t).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, found.T), digest],
                                                 ["doc_id", "part", *MEASURES, "digest"])

    return source.mapInArrow(run, schema)


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, part_col: str = "lang",
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the set of filters they fail (bit i: the i-th filter)."""
    plain = [f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(filters.values()) if rule != COPY]
    copy_bits = sum(1 << i for i, rule in enumerate(filters.values()) if rule == COPY)
    slim = measured(docs, part_col, id_col, text_col).select(
        "doc_id", "part", "digest", F.expr(" + ".join(["0", *plain])).cast("int").alias("mask"))
    slim = cut(slim, "measured")
    marks = (labels.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long").alias("good"),
                           F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long").alias("toxic"))
             .filter("doc_id IS NOT NULL AND good + toxic > 0").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")))
    named = slim.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    key = ["mask", "part", "good", "toxic"]
    # the join has laid rows out by id, which serves this too: repeated rows become one
    rows = cut(named.groupBy("doc_id", "digest", *key).agg(F.count("*").alias("n")), "rows")
    nameless = slim.filter("doc_id IS NULL").groupBy("mask", "part").agg(F.count("*").alias("n")).select(
        "mask", "part", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"), "n")
    entry = F.struct("part", "good", "toxic", "n")
    of_id = rows.groupBy("doc_id", "digest", "mask").agg(F.sort_array(F.collect_list(entry)).alias("entries"))  # one a part and label
    # the rows of each text's smallest id; a third of all rows under one digest costs one row a task
    first = of_id.groupBy("digest").agg(F.min(F.struct("doc_id", "mask", "entries")).alias("f")).select(
        F.col("f.mask").alias("mask"), F.inline("f.entries")).select(*key, "n")
    later = rows.select(*key, "n").union(first.select(*key, -F.col("n"))).groupBy(*key).agg(F.sum("n").alias("n")).withColumn(
        "mask", F.col("mask").bitwiseOR(F.lit(copy_bits)))
    return later.union(first).union(nameless.select(*key, "n")).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """Every part, order and step of the filters named by single ``letters``, from counts by mask."""
    orders = ",".join("".join(p) for p in permutations(letters))
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2 ** filters at most
    steps = cells.select("part", "cells", F.explode(F.split(F.lit(orders), ",")).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))

    def bits(of):
        return sum((F.when(F.instr(of, x) > 0, 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))

    steps = steps.withColumn("bit", bits(F.expr("substring(filter_order, step, 1)"))).withColumn(
        "before", bits(F.expr("substring(filter_order, 1, step - 1)")))

    def total(which, value) -> F.Column:
        return F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda acc, c: acc + value(c))

    def fails(c):
        return c["mask"].bitwiseAND(F.col("bit")) != 0

    def gone(c):
        return c["mask"].bitwiseAND(F.col("before")) != 0

    def here(c):
        return fails(c) & ~gone(c)

    ways = factorial(len(letters))
    return steps.select(
        "part", "filter_order", "step",
        total(lambda c: ~fails(c) & ~gone(c), lambda c: c["n"]).alias("kept"),
        total(here, lambda c: c["n"]).alias("removed"),
        total(lambda c: fails(c) & gone(c), lambda c: c["n"]).alias("redundant"),
        total(lambda c: c["mask"] == F.col("bit"), lambda c: c["n"]).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        # each of the filters a document fails is the first of them in an equal share of all orders
        total(fails, lambda c: (c["n"] * F.lit(ways) / F.bit_count(c["mask"])).cast("long")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, part_col: str = "lang",
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``filters``: letter -> failure condition (SQL over ``MEASURES``, or ``later_copy``).  Null texts are empty; null parts
    and empty ones are one part; a row without an id has no labels and is no copy of any text, nor any text a copy of it;
    repeated rows count each and are no copies of themselves; of several labels of an id any 1 holds; other columns are not read;
    an empty table gives an empty result."""
    return interactions(mask_counts(docs, labels, filters, part_col, id_col, text_col), "".join(filters))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
      + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
      + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
      AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
      FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, bit,
      sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
      sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
      sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
      sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
      sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
      sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
"""
