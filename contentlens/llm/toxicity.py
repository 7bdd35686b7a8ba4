"""Toxicity by weak supervision (after Ratner et al. 2017): voters, a generative label model, a linear classifier.

Voters vote on a text from hand-written insult lists, from lexicons and word-beginning patterns mined
from training labels (words or beginnings seen far more often in toxic texts, dealt to several voters), and
from simple patterns; each votes toxic, clean or abstains.  The label model is a
tree-structured naive Bayes model fitted by expectation maximisation without labels: every voter has an accuracy
table given the true class and, where the votes of two voters stay dependent given the class, given one
other voter (maximum spanning tree of conditional mutual information), so correlated voters
do not count twice.  A linear classifier (logistic regression with an L1 penalty, presence of words and word
beginnings) is trained on the model's posteriors and scores every text.

Everything is learnt on a bounded sample of labelled documents outside the held-out part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, split_remainder, training_sample
from .hashing import Pieces, batches, mixed

PER_CLASS = 2000     # bound of the training sample: at most this many labelled documents of each class
FEATURES = 32_768    # bound of the features looked at, besides the seed words: at most 2 * 2,000 * 32,768 hashes reach the driver
TOXIC = 0.3
BEGINNINGS = (3, 4, 5, 6, 7)
MINED_VOTERS = 12    # mined words and mined beginnings are dealt to this many voters each
MIN_DOCS = 4         # features of the classifier stand in at least so many sampled documents
SCREEN = 18.0        # and have at least this likelihood ratio with the posteriors
VOTER_RATE, FEATURE_RATE = 0.55, 0.4   # toxic share, in the corpus, of the texts that hold a mined voter's or classifier's feature
STRONG, MILD = 30.0, 15.0   # likelihood ratios from which a word or beginning is mined for the voters
L1 = 3e-4
EPOCHS = 24
SEEN_SHARE = 0.5      # share of a text's features seen in a training step, so that few insults suffice

#: Insults and slurs on character, by language; one voter a list.
SEED_LISTS = {
    "en_insult": "idiot moron stupid loser imbecile fool dumb dunce clown jerk",
    "en_contempt": "scum trash garbage worthless pathetic disgusting vile filth vermin parasite",
    "en_hostile": "hate kill die destroy hang burn shut",
    "en_vulgar": "damn crap hell bastard bitch asshole bullshit shit fuck fucking",
    "de_insult": "idiot trottel dummkopf abschaum arschloch schwachkopf versager dumm widerlich scheisse",
    "fr_insult": "idiot imbécile crétin connard salaud ordure stupide minable nul merde",
    "es_insult": "idiota imbécil estúpido basura escoria asqueroso inútil cabrón payaso mierda",
}


def _hash_words(words: list[str]) -> np.ndarray:
    p = Pieces(words)
    return np.unique(_folded(p.words(), 0))


_KIND = np.uint64(0x8EBC6AF09C88C6E3)


def _folded(h: np.ndarray, kind: int) -> np.ndarray:
    """0: whole words; otherwise beginnings of that length."""
    return mixed(h + np.uint64(int(_KIND) * kind % (1 << 64)))


def _clean(texts: list[str]) -> list[str]:
    """Lower case; everything but letters becomes a space."""
    return ["".join(c if c.isalpha() else " " for c in t.lower()) if not t.isascii() else t.lower().translate(_ASCII)
            for t in texts]


_ASCII = {i: " " for i in range(128) if not chr(i).isalpha()}


def token_features(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each batch: (first text, texts, document of each feature, feature hash); words, then beginnings of longer words."""
    for first, part in batches(texts):
        p = Pieces(_clean(part))
        docs, hashes = [p.w_doc], [_folded(p.words(), 0)]
        for n in BEGINNINGS:
            longer = p.w_end - p.w_start > n
            s = p.w_start[longer]
            docs.append(p.w_doc[longer])
            hashes.append(_folded(p.hashes(s, s + n), n))
        yield first, len(part), np.concatenate(docs), np.concatenate(hashes)


def feature_sets(texts: list[str]) -> list[np.ndarray]:
    """Distinct feature hashes of each text."""
    out: list[np.ndarray] = []
    for _, n_docs, docs, hashes in token_features(texts):
        order = np.argsort(docs, kind="stable")
        cuts = np.searchsorted(docs[order], np.arange(n_docs + 1))
        per = [np.unique(hashes[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]
        out += per
    return out


def _lift(toxic: np.ndarray, seen: np.ndarray, share: float, balance: float) -> tuple[np.ndarray, np.ndarray]:
    """(share of toxic texts among those with a feature, likelihood ratio of a rate above the sample's share).

    The first is brought from the balanced sample to the corpus: ``balance`` clean texts stand behind each sampled one
    for every toxic text behind a sampled toxic one."""
    rate = np.clip(toxic / seen, 1e-9, 1 - 1e-9)
    g2 = 2 * seen * (rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share)))
    return rate / (rate + balance * (1 - rate)), np.where(rate > share, g2, 0)


class Voters:
    """Votes from sets of feature hashes: 1 toxic, 0 clean, -1 abstains."""

    def __init__(self, y: np.ndarray, sets: list[np.ndarray], balance: float = 1.0):
        self.lists = [_hash_words(v.split()) for v in SEED_LISTS.values()]
        every, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        per = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        toxic = np.bincount(inverse, y[per] == 1, len(every))
        clean = np.bincount(inverse, y[per] == 0, len(every))
        n1, n0 = max(1, (y == 1).sum()), max(1, (y == 0).sum())
        rate, g2 = _lift(toxic, toxic + clean, n1 / (n1 + n0), balance)
        told = np.flatnonzero((g2 >= STRONG) & (rate >= VOTER_RATE))
        told = told[np.argsort(-g2[told], kind="stable")]
        self.lists += [np.sort(every[told[k::MINED_VOTERS]]) for k in range(MINED_VOTERS)]
        self.strong = np.sort(every[told])
        self.mild = np.sort(every[(g2 >= MILD) & (g2 < STRONG) & (rate >= FEATURE_RATE)])

    def votes(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row a text.  The lists vote toxic or abstain; the last three voters also vote clean."""
        out = np.full((len(sets), len(self.lists) + 3), -1, np.int8)
        for i, s in enumerate(sets):
            for j, words in enumerate(self.lists):
                if len(words) and np.isin(words, s, assume_unique=True).any():
                    out[i, j] = 1
            hits = int(np.isin(self.strong, s, assume_unique=True).sum())
            seeded = int((out[i, :len(SEED_LISTS)] == 1).sum())
            mild = int(np.isin(self.mild, s, assume_unique=True).sum())
            out[i, -3] = 1 if hits >= 2 else 0 if hits == 0 else -1
            out[i, -2] = 0 if seeded == 0 and hits == 0 else -1 if hits < 3 else 1
            out[i, -1] = 1 if mild >= 3 and hits else 0 if mild == 0 else -1
        return out


class LabelModel:
    """P(class) * product of P(vote | class, parent's vote), fitted by expectation maximisation."""

    def __init__(self, votes: np.ndarray, rounds: int = 40, smooth: float = 0.5, least: float = 0.02):
        v = votes.astype(np.int64) + 1  # 0 abstains, 1 clean, 2 toxic
        pattern, index, count = np.unique(v, axis=0, return_inverse=True, return_counts=True)
        weight, voters = count.astype(float), v.shape[1]
        # start: the majority of the votes that were cast
        lean = (pattern == 2).sum(1) - (pattern == 1).sum(1)
        q = 1 / (1 + np.exp(-1.5 * lean.astype(float)))
        self.parent = np.full(voters, -1)
        for step in range(rounds):
            if step in (5, 15):
                self.parent = self._tree(pattern, weight, q, least)
            self.prior = float(np.clip((weight * q).sum() / weight.sum(), 0.01, 0.99))
            self.tables = [self._table(pattern, weight, q, j, smooth) for j in range(voters)]
            q = self._posterior(pattern)
        self.posteriors = q[index.reshape(-1)]

    def _table(self, pattern, weight, q, j, smooth):
        """log P(vote j | class, parent's vote): [class, parent vote or 0, vote]."""
        par = pattern[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(pattern), np.int64)
        t = np.full((2, 3, 3), smooth)
        for c, w in ((0, weight * (1 - q)), (1, weight * q)):
            np.add.at(t[c], (par, pattern[:, j]), w)
        return np.log(t / t.sum(axis=2, keepdims=True))

    def _posterior(self, pattern):
        z = np.full(len(pattern), np.log(self.prior / (1 - self.prior)))
        for j, t in enumerate(self.tables):
            par = pattern[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(pattern), np.int64)
            z += t[1, par, pattern[:, j]] - t[0, par, pattern[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    @staticmethod
    def _tree(pattern, weight, q, least):
        """Parents by the maximum spanning forest of mutual information given the class."""
        voters = pattern.shape[1]
        info = np.zeros((voters, voters))
        for c, w in ((0, weight * (1 - q)), (1, weight * q)):
            total = w.sum()
            if total < 1:
                continue
            hot = [(pattern == k).astype(float) for k in range(3)]
            single = [(w @ h) / total for h in hot]
            for a in range(3):
                for b in range(3):
                    joint = (hot[a] * w[:, None]).T @ hot[b] / total
                    apart = np.outer(single[a], single[b])
                    ok = (joint > 1e-12) & (apart > 1e-12)
                    info[ok] += (total / weight.sum()) * joint[ok] * np.log(joint[ok] / apart[ok])
        parent, inside = np.full(voters, -1), [0]
        left = set(range(1, voters))
        while left:  # Prim; an edge weaker than ``least`` is no edge
            a, b = max(((a, b) for a in inside for b in left), key=lambda e: (info[e], -e[0], -e[1]))
            parent[b] = a if info[a, b] >= least else -1
            inside.append(b)
            left.discard(b)
        return parent


class Classifier:
    """Sparse linear model over feature hashes."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], bias
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if len(self.keys):
            for first, _, docs, hashes in token_features(texts):
                at = self.maybe[hashes >> np.uint64(44)]
                docs, hashes = docs[at], hashes[at]
                place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
                hit = self.keys[place] == hashes
                seen = np.unique(docs[hit].astype(np.int64) * len(self.keys) + place[hit])  # presence, not count
                np.add.at(z, first + seen // len(self.keys), self.weights[seen % len(self.keys)])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train_classifier(sets: list[np.ndarray], q: np.ndarray, prior_shift: float, balance: float = 1.0, seed: int = 11) -> Classifier:
    """Logistic regression on soft labels by proximal stochastic gradient descent (L1, AdaGrad steps).

    Weights are kept at zero or above: words are evidence of toxicity or none, so a long clean text cannot
    outweigh an insult in it."""
    every, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    per = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    rate, g2 = _lift(np.bincount(inverse, q[per], len(every)), count, float(np.clip(q.mean(), 1e-6, 1 - 1e-6)), balance)
    often = np.flatnonzero((count >= MIN_DOCS) & (g2 >= SCREEN) & (rate >= FEATURE_RATE))
    to = np.full(len(every), -1)
    to[often] = np.arange(len(often))
    ends = np.cumsum([0] + [len(s) for s in sets])
    rows = [to[inverse[a:b]] for a, b in zip(ends[:-1], ends[1:])]
    rows = [r[r >= 0] for r in rows]
    w, g2, bias, b2 = np.zeros(len(often)), np.full(len(often), 1.0), 0.0, 1.0
    seen, step = np.zeros(len(often), np.int64), 0
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            r = rows[i][rng.random(len(rows[i])) < SEEN_SHARE]
            step += 1
            # the penalty of the steps in which a feature was absent is paid when it comes back
            due = L1 * (step - seen[r]) / np.sqrt(g2[r])
            w[r] = np.maximum(w[r] - due, 0)
            seen[r] = step
            err = 1 / (1 + np.exp(-np.clip(w[r].sum() + bias, -30, 30))) - q[i]
            g2[r] += err * err
            w[r] = np.maximum(w[r] - 0.5 * err / np.sqrt(g2[r]), 0)
            b2 += err * err
            bias -= 0.5 * err / np.sqrt(b2)
    w = np.maximum(w - L1 * (step - seen) / np.sqrt(g2), 0)
    live = np.flatnonzero(w > 1e-2)
    return Classifier(every[often][live], w[live], bias + prior_shift)


def sample_sets(sample: DataFrame, features: int = FEATURES) -> tuple[np.ndarray, list[np.ndarray]]:
    """(class, feature hashes) of each sampled text, for the seed words and the ``features`` that tell most.

    Spark counts every feature of the sample by class and keeps those of two or more texts with the greatest
    likelihood ratio for class 1 (ties: more texts, smaller hash), so that the driver receives at most
    ``features`` hashes and as many a text, however long texts are."""
    def hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for lo in range(0, len(pdf), 16):  # a few long texts at a time
                part = pdf.iloc[lo:lo + 16]
                yield pd.DataFrame({"y": part["y"], "f": [s.view(np.int64) for s in feature_sets(part["text"].tolist())]})

    sets = cut(sample.mapInPandas(hashed, "y int, f array<long>"), "toxic-features")
    sizes = {r["y"]: r["n"] for r in sets.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return np.repeat([0, 1], [n0, n1]), [np.zeros(0, np.uint64)] * (n0 + n1)
    share = n1 / (n0 + n1)
    rate = F.col("toxic") / F.col("n")
    part = lambda r, of: F.when(r > 0, r * F.log(r / F.lit(of))).otherwise(0.0)
    ratio = F.when(rate > share, F.col("n") * (part(rate, share) + part(1 - rate, 1 - share))).otherwise(0.0)
    best = (sets.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
            .filter("n > 1").orderBy(ratio.desc(), F.desc("n"), "f").limit(features))
    seeds = np.concatenate([_hash_words(v.split()) for v in SEED_LISTS.values()])
    kept = np.unique(np.concatenate([seeds, np.array([r["f"] for r in best.select("f").collect()], np.int64).view(np.uint64)]))

    def narrowed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"y": pdf["y"], "f": [
                np.intersect1d(np.asarray(s, np.int64).view(np.uint64), kept, assume_unique=True).tobytes() for s in pdf["f"]]})

    got = sorted((r["y"], bytes(r["f"])) for r in sets.mapInPandas(narrowed, "y int, f binary").collect())
    return np.array([y for y, _ in got]), [np.frombuffer(f, np.uint64) for _, f in got]


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", per_class: int = PER_CLASS,
        features: int = FEATURES) -> Classifier:
    """Voters, label model and classifier from a bounded sample, of which ``features`` feature hashes are looked at.

    Without labels of both classes every text scores the share of class 1 (0 without any)."""
    sample, counts = training_sample(docs, labels, target, per_class)
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), 20.0 if n1 else -20.0)
    y, sets = sample_sets(sample, features)
    if len(set(y.tolist())) < 2:
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), float(np.log(n1 / n0)))
    sampled = max(1, (y == 1).sum()) / max(1, (y == 0).sum())
    balance = float(n0 / n1 * sampled)
    posteriors = LabelModel(Voters(y, sets, balance).votes(sets)).posteriors
    return train_classifier(sets, posteriors, -float(np.log(balance)), balance)


def score_documents(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts have no features and score the bias alone; repeated rows are scored alike; other
    columns are not read; an empty table gives an empty result."""
    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.scores(text.fillna("").tolist()))

    return (docs.select(F.col(id_col).alias("doc_id"), (split_remainder(F.col(id_col)) == 2).alias("held_out"),
                        score(F.col(text_col)).alias("score"))
            .select("doc_id", "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted")))
