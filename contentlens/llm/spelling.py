"""Spelling variants: words one edit apart, by search schemes over bidirectional FM-indexes.

A word with one error keeps its left or its right half.  Scheme one matches the left half exactly and extends to the right across the
other with one error; scheme two matches the right half and extends to the left.  An index holds the delimited words
(delimiter, word, delimiter, ..) and the same words reversed, so both directions are backward searches: a state is an interval
of suffix ranks, and a step by a symbol maps both ends by the last-to-first mapping.  All queries of a length
advance together.  Stepping over the delimiter at the end leaves the one rank of a whole word.

Spark counts the words, deals them by their first and by their last code points (the least that an exact half shares, so
near words meet), and each group builds the index of its direction and searches its own words.  A group above
``BLOCK`` words is searched in pairs of blocks.  A task returns one row a word: how many near words, and the most frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fixed values of the contract.
LETTERS = "A-Za-zÀ-ÿ"
EVERY = 31            # a run is misspelt if its hash is divisible by this
LEAST_LENGTH = 7
LEAST_COUNT = 2
FREQUENCY_RATIO = 10

BLOCK = 40_000        # words of an index, and queries of a task
FEW = 256             # ranks of an interval that are looked at one by one
STATES = 1 << 20      # ranks looked at in one go
DELIMITER = 1         # symbols are Latin-1 codes, which hold every letter of the contract


class Index:
    """FM-index of delimited words: suffix array, last column, and its positions by symbol."""

    def __init__(self, words: list[bytes]):
        """``words``: distinct; none holds a code of ``DELIMITER`` or less."""
        mark = bytes([DELIMITER])
        text = np.frombuffer(mark + mark.join(words) + mark + b"\0", np.uint8)
        self.n = n = len(text)
        self.starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)[:-1]))
        self.suffixes = suffix_array(text)
        self.last = text[self.suffixes - 1]
        #: symbol * n + rank, sorted: the place of (symbol, rank) is the rank after a step by the symbol
        self.places = np.sort(self.last.astype(np.int64) * n + np.arange(n))
        self.after = np.empty(n, np.int64)
        self.after[self.places % n] = np.arange(n)
        self.symbols = np.setdiff1d(np.unique(text), [0, DELIMITER]).astype(np.int64)

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``symbol`` put before them."""
        base = np.asarray(symbol, np.int64) * self.n
        return np.searchsorted(self.places, base + low), np.searchsorted(self.places, base + high)

    def every_step(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(state, symbol, low, high) for all symbols but the delimiter that stand before a state's pattern."""
        found = []
        size = high - low
        few = np.flatnonzero(size <= FEW)
        at = 0
        while at < len(few):
            to = at + max(1, int(np.searchsorted(np.cumsum(size[few[at:]]), STATES, "right")))
            state = np.repeat(few[at:to], size[few[at:to]])
            ends = np.cumsum(size[few[at:to]])
            rank = np.arange(len(state)) - np.repeat(ends - size[few[at:to]], size[few[at:to]]) + low[state]
            symbol = self.last[rank].astype(np.int64)
            letter = symbol > DELIMITER
            key = state[letter] * 256 + symbol[letter]
            after = self.after[rank[letter]]
            order = np.lexsort((after, key))
            key, after = key[order], after[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(key)) - 1 if len(key) else first
            found.append((key[first] // 256, key[first] % 256, after[first], after[last] + 1))  # one symbol's ranks are neighbours
            at = to
        many = np.flatnonzero(size > FEW)
        for s in self.symbols if len(many) else ():
            lo, hi = self.step(low[many], high[many], s)
            some = lo < hi
            found.append((many[some], np.full(int(some.sum()), s), lo[some], hi[some]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none, none
        return tuple(np.concatenate(c) for c in zip(*found))

    def word_at(self, rank: np.ndarray) -> np.ndarray:
        """Numbers of the words before which the delimiters of these ranks stand."""
        return np.searchsorted(self.starts, self.suffixes[rank])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes by doubling the length they are sorted by, from 8 symbols on."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.ndarray((n,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
    length = 8
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        if rank[order[-1]] == n - 1:
            return order
        second = np.zeros(n, np.int64)
        second[:max(0, n - length)] = rank[length:] + 1
        key = rank * (n + 1) + second
        length *= 2


def one_error(index: Index, queries: np.ndarray, exact: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) where the word is one edit from the query and the edit lies before the query's last ``exact`` symbols.

    ``queries``: a matrix of symbols, one query of the same length a row.  Each pair comes once: of equal places for an
    inserted or deleted symbol within a run, only the one farthest to the left counts."""
    count, length = queries.shape
    low, high = index.step(np.zeros(count, np.int64), np.full(count, index.n), DELIMITER)
    query = np.arange(count)
    hurt_q = hurt_low = hurt_high = np.zeros(0, np.int64)  # states with one error

    def alive(q, lo, hi):
        some = lo < hi
        return q[some], lo[some], hi[some]

    for i in range(length - 1, -1, -1):
        symbol = queries[:, i].astype(np.int64)
        if i >= length - exact:
            query, low, high = alive(query, *index.step(low, high, symbol[query]))
            continue
        state, other, lo, hi = index.every_step(low, high)
        unlike = other != symbol[query[state]]
        state, lo, hi = state[unlike], lo[unlike], hi[unlike]
        # one symbol more in the word: this place is still to be matched
        hurt_q, hurt_low, hurt_high = (np.concatenate(x) for x in ((hurt_q, query[state]), (hurt_low, lo), (hurt_high, hi)))
        hurt_q, hurt_low, hurt_high = alive(hurt_q, *index.step(hurt_low, hurt_high, symbol[hurt_q]))
        # one symbol less: the last of a run of equal ones
        gone = np.ones(len(query), bool) if i == 0 else queries[query, i - 1] != queries[query, i]
        hurt_q = np.concatenate((hurt_q, query[state], query[gone]))
        hurt_low, hurt_high = np.concatenate((hurt_low, lo, low[gone])), np.concatenate((hurt_high, hi, high[gone]))
        query, low, high = alive(query, *index.step(low, high, symbol[query]))
    state, _, lo, hi = index.every_step(low, high)
    hurt_q, hurt_low, hurt_high = (np.concatenate(x) for x in ((hurt_q, query[state]), (hurt_low, lo), (hurt_high, hi)))
    hurt_q, hurt_low, _ = alive(hurt_q, *index.step(hurt_low, hurt_high, DELIMITER))
    return hurt_q, index.word_at(hurt_low)


def near_words(queries: list[bytes], words: list[bytes], left_exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, word) numbers of pairs one edit apart that one scheme finds.

    ``left_exact``: the query's left half is kept; else its right half is and its left is not, so the schemes share no pair."""
    index = Index([w[::-1] for w in words] if left_exact else words)
    sizes = np.fromiter(map(len, queries), np.int64, len(queries))
    for size in np.unique(sizes):
        of = np.flatnonzero(sizes == size)
        half = int(size) // 2
        matrix = np.frombuffer(b"".join(queries[i] for i in of), np.uint8).reshape(len(of), int(size))
        if left_exact:
            q, w = one_error(index, matrix[:, ::-1], half)
            yield of[q], w
        else:
            q, w = one_error(index, matrix, int(size) - half)
            q = of[q]
            changed = np.fromiter((not words[b].startswith(queries[a][:half]) for a, b in zip(q.tolist(), w.tolist())), bool, len(q))
            yield q[changed], w[changed]


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the contract's words of all whole texts, with planted misspellings, and their occurrences.

    A text without words and a null text give none; a null id counts as empty text."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    # runs below the least length cannot give a word, as runs only become shorter
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least_length},}}"), 0)
    run = docs.select(ident.alias("doc_id"), F.explode(runs).alias("run"))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    run = run.select("doc_id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", capitals, capitals.lower())).otherwise(
        F.col("run")).alias("run"))
    h = F.crc32(F.concat_ws(":", "doc_id", "run").cast("binary"))
    run = run.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut_out = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % every == 0, cut_out).otherwise(F.col("run"))
    return (run.select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= least_count))


def near_counts(vocabulary: DataFrame, key: int = LEAST_LENGTH // 2, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best): for each word with near ones their number and the most frequent, as (minus n, near).

    ``vocabulary`` has (word, n), distinct words of ``2 * key + 1`` Latin-1 letters or more."""
    size = vocabulary.count()
    groups = max(1, -(-size // block) * 2)

    def dealt(kind: str, of: Column) -> DataFrame:
        return vocabulary.select(F.lit(kind).alias("kind"), F.pmod(F.xxhash64(of), F.lit(groups)).alias("grp"), "word", "n")

    both = dealt("left", F.substring("word", 1, key)).union(dealt("right", F.expr(f"right(word, {key})")))
    loads = both.groupBy("kind", "grp").agg(F.ceil(F.count("*") / block).alias("blocks"))
    placed = both.join(loads, ["kind", "grp"]).withColumn("own", F.pmod(F.xxhash64("word", F.lit(7)), F.col("blocks")))
    # as a query a word meets every block of its group, as an indexed word the queries of every block
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    pairs = F.concat(F.transform(others, lambda b: F.struct(F.col("own").alias("asks"), b.alias("holds"), F.lit(True).alias("query"))),
                     F.transform(others, lambda a: F.struct(a.alias("asks"), F.col("own").alias("holds"), F.lit(False).alias("query"))))
    routed = placed.select("kind", "grp", "word", "n", F.inline(pairs))

    def run(group: pa.Table) -> pa.Table:
        table = group.select(["word", "n", "query"]).to_pydict()
        queries = [w.encode("latin-1") for w, q in zip(table["word"], table["query"]) if q]
        held = sorted((w.encode("latin-1"), n) for w, n, q in zip(table["word"], table["n"], table["query"]) if not q)
        none = np.zeros(0, np.int64)
        q = w = none
        if queries and held:
            found = list(near_words(queries, [w for w, _ in held], group.column("kind")[0].as_py() == "left"))
            q, w = (np.concatenate(x) for x in zip(*found)) if found else (none, none)
        n = np.fromiter((n for _, n in held), np.int64, len(held))[w] if held else none
        order = np.lexsort((w, -n, q))  # words are sorted by code point
        q, w, n = q[order], w[order], n[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else none
        near = np.diff(np.append(first, len(q)))
        return pa.table({"word": pa.array([queries[i].decode("latin-1") for i in q[first]], pa.string()), "n_near": near.astype(np.int64),
                         "best_n": n[first], "best": pa.array([held[i][0].decode("latin-1") for i in w[first]], pa.string())})

    found = routed.groupBy("kind", "grp", "asks", "holds").applyInArrow(run, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct(
        (-F.col("best_n")).alias("minus_n"), F.col("best").alias("near"))).alias("best"))


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a ``form``: pointers are doubled until none moves.

    Every form is ``FREQUENCY_RATIO`` times as frequent as its word, so chains are short and free of cycles."""
    roots = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("up"))
        raised = cut(roots.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")),
                     "roots")
        roots = raised.select("word", "root")
        if not raised.filter("moved").limit(1).count():
            return roots


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY,
                      ratio: int = FREQUENCY_RATIO, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Null and empty texts give no words; repeated rows count each; a null id is hashed as empty text; ties go to the smaller
    word in code-point order; other columns are not read; an empty table gives an empty result.  A run of any length is one word."""
    vocabulary = cut(count_words(docs, least_length, least_count, every, id_col, text_col), "vocabulary")
    near = near_counts(vocabulary, least_length // 2, block)
    minus = F.col("best.minus_n")
    is_form = -minus >= ratio * F.col("n")
    formed = cut(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -minus).alias("form_n")), "formed")
    roots = follow_forms(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
