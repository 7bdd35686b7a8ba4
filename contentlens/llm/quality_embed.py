"""Quality classifier: supervised subword embeddings (after Joulin et al. 2016).

A text is the bag of its hashed pieces: words, word pairs, character 3- to 5-grams within words (with
their borders) and, for repetition, one back-reference piece for every word already seen in the text
(its distance to the last occurrence, by power of two).  Each bucket has a learned vector; a document is the
average of its pieces' vectors, a softmax layer gives the class, and both are trained together by
numpy stochastic gradient descent.  Softmax of an average is linear in the pieces, so scoring uses
one logit per bucket (the vector times the output layer), which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, split_remainder, training_sample
from .hashing import Pieces, batches, mixed

BITS = 15          # buckets = 2 ** BITS
DIM = 8
EPOCHS = 8
RATE = 0.4
PER_CLASS = 1500   # bound of the training sample: at most this many labelled documents of each class
KEEP = 0.7

_PAIR = np.uint64(0xA0761D6478BD642F)
_BACK = np.uint64(0xE7037ED1A0B428DB)


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def _back_references(p: Pieces, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of a piece for every word that stood earlier in the same text."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    order = np.lexsort((np.arange(len(words)), words, p.w_doc))
    again = (words[order][1:] == words[order][:-1]) & (p.w_doc[order][1:] == p.w_doc[order][:-1])
    gap = (order[1:] - order[:-1])[again]
    return p.w_doc[order[1:][again]], mixed(np.log2(gap).astype(np.uint64) + _BACK)


def pieces_of(texts: list[str]) -> Iterator[tuple[int, int, list[tuple[np.ndarray | None, np.ndarray, np.ndarray | None]]]]:
    """For each batch: (first text, texts, groups of (document or None for 'by position', bucket, valid or None))."""
    for first, part in batches(texts):
        p = Pieces(part)
        words = p.words()
        pair_ok = p.w_doc[1:] == p.w_doc[:-1]
        pairs = mixed(words[:-1] * _PAIR + words[1:])[pair_ok]
        back_doc, back = _back_references(p, words)
        groups = [(p.w_doc, _buckets(words)), (p.w_doc[1:][pair_ok], _buckets(pairs)), (back_doc, _buckets(back))]
        by_position = []
        for n in (3, 4, 5):
            h, ok = p.char_ngrams(n)
            by_position.append((_buckets(h), ok))
        yield first, p, groups, by_position


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text; the shares of a text sum to one (no pieces: empty)."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for _, p, groups, by_position in pieces_of(texts):
        n_docs = len(p.starts)
        doc_of = np.repeat(np.arange(n_docs), np.diff(np.concatenate((p.starts, [p.n]))))
        keys = [d.astype(np.int64) << BITS | b for d, b in groups]
        keys += [(doc_of[:len(b)][ok].astype(np.int64) << BITS) | b[ok] for b, ok in by_position]
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        docs, bucket = key >> BITS, (key & ((1 << BITS) - 1)).astype(np.int16)
        cuts = np.searchsorted(docs, np.arange(n_docs + 1))
        for i in range(n_docs):
            c = count[cuts[i]:cuts[i + 1]].astype(np.float32)
            out.append((bucket[cuts[i]:cuts[i + 1]], c / c.sum() if len(c) else c))
    return out


def score_texts(texts: list[str], logits: np.ndarray, bias: float) -> np.ndarray:
    """Probability of class 1 for each text."""
    z = np.zeros(len(texts))
    for first, p, groups, by_position in pieces_of(texts):
        n_docs = len(p.starts)
        total, count = np.zeros(n_docs), np.zeros(n_docs)
        for d, b in groups:
            total += np.bincount(d, logits[b], n_docs)
            count += np.bincount(d, minlength=n_docs)
        for b, ok in by_position:
            vals, held = np.zeros(p.n), np.zeros(p.n)
            vals[:len(b)] = np.where(ok, logits[b], 0)
            held[:len(b)] = ok
            total += np.add.reduceat(vals, p.starts)
            count += np.add.reduceat(held, p.starts)
        z[first:first + n_docs] = total / np.maximum(count, 1)
    return 1 / (1 + np.exp(-np.clip(z + bias, -60, 60)))


class Model:
    """``logits`` (one per bucket) and ``bias`` of class 1 against class 0."""

    def __init__(self, logits: np.ndarray, bias: float):
        self.logits, self.bias = logits, bias


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], prior: float, seed: int = 7) -> Model:
    """Plain SGD, one document a step, linearly falling rate; ``prior`` is the log odds of class 1
    over all training labels, added because the sample is balanced."""
    rng = np.random.default_rng(seed)
    vec = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            y, ids, share = rows[i]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            held = vec[ids]
            h = share @ held
            z = h @ out + bias
            e = np.exp(z - z.max())
            g = e / e.sum()
            g[y] -= 1
            # the average damps each piece's gradient; it is scaled back by the piece count's root
            vec[ids] = held - np.outer(rate * np.sqrt(len(ids), dtype=np.float32) * share, out @ g)
            out -= rate * np.outer(h, g)
            bias -= rate * g
    diff = out[:, 1] - out[:, 0]
    return Model((vec @ diff).astype(np.float32), float(bias[1] - bias[0]) + prior)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Train on a bounded sample (``per_class`` documents of each class, whole texts).

    The driver receives the sample's bucket shares: at most 2 * per_class * 2 ** BITS entries of
    six bytes.  Without labels of both classes every text scores the share of class 1 (0.5 without any).
    """
    sample, counts = training_sample(docs, labels, target, per_class)
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        odds = 0.0 if n0 == n1 else (20.0 if n1 else -20.0)
        return Model(np.zeros(1 << BITS, np.float32), odds)

    def hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            f = features(pdf["text"].tolist())
            yield pd.DataFrame({"y": pdf["y"], "ids": [a.tobytes() for a, _ in f], "share": [b.tobytes() for _, b in f]})

    # packed bytes: a list of boxed numbers would take ten times the memory
    got = sorted(sample.mapInPandas(hashed, "y int, ids binary, share binary").collect())
    rows = [(y, np.frombuffer(ids, np.int16), np.frombuffer(share, np.float32)) for y, ids, share in got if ids]
    if len({r[0] for r in rows}) < 2:
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(n1 / n0)))
    return train(rows, float(np.log(n1 / n0)))


def scorer(model: Model):
    """Arrow-batched column function: text -> score (null counts as empty)."""
    logits, bias = model.logits, model.bias

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(score_texts(text.fillna("").tolist(), logits, bias))

    return score


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Null and empty texts have no pieces and score the bias alone; repeated rows are scored alike; other columns
    are not read; an empty table gives an empty result.
    """
    return (docs.select(F.col(id_col).alias("doc_id"), (split_remainder(F.col(id_col)) == 2).alias("held_out"),
                        scorer(model)(F.col(text_col)).alias("score"))
            .select("doc_id", "held_out", "score", (F.col("score") >= KEEP).cast("int").alias("predicted")))


def keep_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, columns unchanged."""
    name = free_name(docs, "_quality")
    return docs.withColumn(name, scorer(model)(F.col(text_col))).filter(F.col(name) >= threshold).drop(name)
