"""Log probabilities of pieces by expectation maximisation over the whole table (after Kudo 2018).

A model file of merges holds merge ranks, not probabilities, so a unigram segmentation needs scores of its own.  Spark counts the
distinct tokens of all texts and stores the lattice of each marker-led word (all pieces that fit, by start and end) once.  A
round runs the forward-backward sums over every lattice in the tasks, which return one expected count a piece; the driver sees one
number a piece of the vocabulary and makes them the next round's probabilities.  No round lowers the likelihood of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .pieces import LONG_WORD, MARK, Codec, Vocabulary

ROUNDS = 3
RARE = 0.01          # expected count of a piece that no text needs, so that it has a score
PLACES = 6           # decimals of a score, so that the order of sums does not show
LATTICES = 4096      # words whose sums run side by side
PLACE_BITS = 6       # of a start or an end, which are at most ``LONG_WORD``
EDGE = 1 << PLACE_BITS


def _chunks(word: bytes) -> Iterator[bytes]:
    """The word, or its parts of at most ``LONG_WORD`` bytes, at character borders."""
    lo = 0
    while len(word) - lo > LONG_WORD:
        hi = lo + LONG_WORD
        while word[hi] & 0xC0 == 0x80:
            hi -= 1
        yield word[lo:hi]
        lo = hi
    yield word[lo:]


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, n): what stands between blanks, in all texts; partially aggregated where it is read."""
    text = docs.select(F.col(text_col).alias("text")).filter(F.length("text") > 0)
    return text.select(F.explode(F.split("text", " ")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def words_of_tokens(codec: Codec, tokens: list[str], counts: list[int]) -> tuple[list[bytes], np.ndarray]:
    """Marker-led words as the codec splits them, and their counts; those above ``LONG_WORD`` bytes in parts."""
    words, n = [], []
    for token, c in zip(tokens, counts):
        data = (MARK + token).encode()
        if len(data) <= LONG_WORD and "\n" not in token and MARK not in token:  # one word, as most are
            words.append(data)
            n.append(c)
            continue
        for i, part in enumerate(token.split(MARK)):  # a marker of the text's own is written as bytes
            for word in codec.words_of(part if i else MARK + part):
                for chunk in _chunks(word.encode()):
                    words.append(chunk)
                    n.append(c)
    return words, np.array(n, np.int64)


def lattices(tokens: DataFrame, codec: Codec) -> DataFrame:
    """(n, size, edges) of the words of all tokens: edges as (piece + 1) * EDGE * EDGE + start * EDGE + end; piece -1 is a character
    no piece matches.  A word may have several rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec.prepare()
        for batch in batches:
            data, n = words_of_tokens(codec, batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for lo in range(0, len(data), 2 * LATTICES):
                part = data[lo:lo + 2 * LATTICES]
                word, start, end, piece = codec.edges(part)
                order = np.argsort(word, kind="stable")
                ends = np.cumsum(np.bincount(word, minlength=len(part)))
                code = ((piece + 1) * EDGE * EDGE + start * EDGE + end)[order].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(n[lo:lo + len(part)]), pa.array(np.fromiter(map(len, part), np.int32, len(part))),
                     pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(code))], ["n", "size", "edges"])

    return tokens.select("token", "n").mapInArrow(run, "n long, size int, edges array<long>")


def expected(sizes: np.ndarray, counts: np.ndarray, word: np.ndarray, code: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, float]:
    """(expected count of each of ``prob``'s pieces, log likelihood) of words given by their edges.

    ``prob[0]`` stands for a character without a piece.  Sums are scaled by a power of the word's length, which keeps them finite."""
    n, size = len(sizes), int(sizes.max())
    piece = code >> 2 * PLACE_BITS
    start, end = (code >> PLACE_BITS).astype(np.uint8) & (EDGE - 1), code.astype(np.uint8) & (EDGE - 1)
    lift = 2.0  # about the information of a byte; taken off again in the likelihood
    weight = prob[piece] * np.exp(lift * np.arange(EDGE))[end - start]
    ahead, back = np.zeros((size + 1, n)), np.zeros((size + 1, n))
    ahead[0] = 1.0
    back[sizes, np.arange(n)] = 1.0
    from_at, to_at = start.astype(np.int64) * n + word, end.astype(np.int64) * n + word  # places in the flat tables
    by_end, by_start = np.argsort(end, kind="stable"), np.argsort(start, kind="stable")
    at_end, at_start = (np.concatenate(([0], np.cumsum(np.bincount(x, minlength=size + 1)))) for x in (end, start))
    flat_ahead, flat_back = ahead.reshape(-1), back.reshape(-1)
    for p in range(1, size + 1):
        e = by_end[at_end[p]:at_end[p + 1]]
        if len(e):
            ahead[p] = np.bincount(word[e], flat_ahead[from_at[e]] * weight[e], n)
    for p in range(size - 1, -1, -1):
        e = by_start[at_start[p]:at_start[p + 1]]
        if len(e):
            back[p] += np.bincount(word[e], flat_back[to_at[e]] * weight[e], n)
    total = ahead[sizes, np.arange(n)]
    share = flat_ahead[from_at] * weight * flat_back[to_at] * (counts / total)[word]
    return np.bincount(piece, share, len(prob)), float((counts * (np.log(total) - lift * sizes)).sum())


def _round(held: DataFrame, prob: np.ndarray) -> tuple[np.ndarray, float]:
    """Expected counts and log likelihood over all lattices."""
    shared = held.sparkSession.sparkContext.broadcast(prob)  # one number a piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, likelihood = np.zeros(len(shared.value)), 0.0
        for batch in batches:
            n, sizes = batch.column(0).to_numpy().astype(float), batch.column(1).to_numpy().astype(np.int64)
            offsets, code = batch.column(2).offsets.to_numpy(), batch.column(2).flatten().to_numpy()
            offsets = offsets - offsets[0]
            for lo in range(0, len(n), LATTICES):
                hi = min(lo + LATTICES, len(n))
                word = np.repeat(np.arange(hi - lo), np.diff(offsets[lo:hi + 1]))
                more, log = expected(sizes[lo:hi], n[lo:hi], word, code[offsets[lo]:offsets[hi]], shared.value)
                total += more
                likelihood += log
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], likelihood))], ["piece", "total"])

    # one partially aggregated row a piece
    got = held.mapInArrow(run, "piece long, total double").groupBy("piece").agg(F.sum("total").alias("total")).toArrow()
    shared.unpersist()
    at, value = got.column(0).to_numpy(), got.column(1).to_numpy()
    out = np.zeros(len(prob))
    out[at[at >= 0]] = value[at >= 0]
    return out, float(value[at < 0].sum())


def estimate(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, text_col: str = "text") -> tuple[Vocabulary, list[float]]:
    """The vocabulary with log probabilities from all texts of ``docs``, and the log likelihood at the start of each round.

    All pieces start alike.  Null and empty texts count nothing; pieces that no text needs get the score of ``RARE`` occurrences; a table
    without words leaves every piece the same score."""
    codec = Codec(vocabulary)
    held = cut(lattices(token_counts(docs, text_col), codec), "lattices")
    scored = np.zeros(len(vocabulary.pieces) + 1, bool)
    scored[np.array(codec.scored_ids, np.int64) + 1] = True

    def probabilities(counts: np.ndarray) -> np.ndarray:
        kept = np.where(scored, np.maximum(counts, RARE), 0.0)
        p = kept / kept.sum()
        p[0] = p[scored].min() * math.exp(-10.0)  # what an unmatched character costs in the codec
        return p

    p, likelihoods = probabilities(np.ones(len(scored))), []
    for _ in range(rounds):
        counts, likelihood = _round(held, p)
        likelihoods.append(likelihood)
        p = probabilities(counts)
    scores = [round(math.log(x), PLACES) if s else old for x, s, old in zip(p[1:].tolist(), scored[1:].tolist(), vocabulary.scores)]
    return replace(vocabulary, scores=scores), likelihoods
