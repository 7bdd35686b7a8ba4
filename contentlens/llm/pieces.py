"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie (after Aoe 1989, Kudo 2018).

The vocabulary (pieces, scores, kinds) is read from a SentencePiece model file on the driver and shipped
to the tasks as arrays; scores of a file that holds merge ranks are estimated anew (``piece_scores.estimate``).  The best segmentation of a text is the one of the highest sum of piece scores; a
character that no piece matches costs the lowest score less ten and is written as its UTF-8 bytes
(byte fallback).  Spaces become the marker U+2581 and a text starts with one; decoding turns markers back and drops the first.
A marker character in the text itself is written as bytes, so that decoding gives every text back exactly.

No piece has a marker behind another character, so the best path of a text is the chain of the best
paths of its marker-led words; each task solves a word once and looks it up afterwards.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6   # fixed values of the file format
UNKNOWN_PENALTY = 10.0                                             # likewise
WINDOW = 512
LONG_WORD = 48    # bytes; longer words are solved one by one
CACHE = 200_000   # words whose path a task remembers; past it the memory is emptied, never the result


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(field, wire type, value) of one protocol-buffer message."""
    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i
    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i:i + n], i + n
        yield key >> 3, kind, value


@dataclass
class Vocabulary:
    """pieces[i] is piece i's text as bytes (a byte piece: that byte), kinds[i] its kind."""

    pieces: list[bytes]
    kinds: list[int]
    scores: list[float]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """Pieces of a model file on the driver's disk."""
        pieces, kinds, scores = [], [], []
        with open(path, "rb") as f:
            data = f.read()
        for field, _, value in _fields(data):
            if field == 1:
                part = {k: v for k, _, v in _fields(value)}
                kind = part.get(3, NORMAL)
                text = part.get(1, b"")
                pieces.append(bytes([int(text[3:5], 16)]) if kind == BYTE else text)
                kinds.append(kind)
                scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
        return cls(pieces, kinds, scores)


class DoubleArray:
    """Trie of byte strings: child of node s by byte c is base[s] + c where check there is s."""

    def __init__(self, words: dict[bytes, int]):
        root: dict = {}
        for word, value in words.items():
            node = root
            for c in word:
                node = node.setdefault(c, {})
            node[-1] = value
        size = 1 << 12
        self.base, self.check, self.value = (np.full(size, x, np.int32) for x in (0, -1, -1))
        used = np.zeros(size, bool)
        used[0] = True
        todo, free = [(0, root)], 1
        while todo:
            at, node = todo.pop()
            self.value[at] = node.get(-1, -1)
            codes = np.array(sorted(c for c in node if c >= 0), np.int64)
            if not len(codes):
                continue
            while free < len(used) and used[free]:
                free += 1
            tried = max(1, free - int(codes[0]))
            while True:  # the first base whose slots are all free, looked for in windows
                while tried + 2 * WINDOW >= len(used):
                    more = len(used)
                    used = np.concatenate((used, np.zeros(more, bool)))
                    self.base, self.check, self.value = (
                        np.concatenate((a, np.full(more, x, np.int32)))
                        for a, x in ((self.base, 0), (self.check, -1), (self.value, -1)))
                fits = ~used[np.arange(tried, tried + WINDOW)[:, None] + codes].any(axis=1)
                if fits.any():
                    tried += int(fits.argmax())
                    break
                tried += WINDOW
            if len(codes) > 1 and tried > free + WINDOW:
                free += WINDOW // 8  # a crowded stretch: give up its last few slots
            self.base[at] = tried
            used[tried + codes] = True
            self.check[tried + codes] = at
            todo += [(tried + int(c), node[int(c)]) for c in codes]


class Codec:
    """Encoder and decoder over one vocabulary; plain arrays, so tasks receive it as it is."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        mark = MARK.encode()
        inner = re.compile(b"(?s).*[^\xe2\x96\x81].*" + mark)
        words: dict[bytes, int] = {}
        for i, (piece, kind) in enumerate(zip(v.pieces, v.kinds)):
            if kind in (NORMAL, USER, UNUSED) and piece:
                if inner.match(piece.replace(mark, b"\xe2\x96\x81")) and piece.lstrip(mark).find(mark) >= 0:
                    raise ValueError("a piece has a marker behind another character")
                words.setdefault(piece, i)
        self.byte_ids = {p[0]: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == BYTE}
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary has no byte pieces to fall back on")
        trie = DoubleArray(words)
        self._arrays = (trie.base, trie.check, trie.value)
        self.scores = v.scores
        self.scored_ids = sorted(words.values())
        scored = [v.scores[i] for i in words.values()]
        self.unknown = min(scored, default=0.0) - UNKNOWN_PENALTY
        self.text = [p.replace(mark, b" ") if k in (NORMAL, USER, UNUSED) else p if k == BYTE else b""
                     for p, k in zip(v.pieces, v.kinds)]
        # characters in no piece always stand alone, so they end a word as well
        held = {c for p in words for c in p.decode()}
        self._line_alone = "\n" not in held
        self._ready = False

    def prepare(self) -> None:
        """Make the tables of a task; done once."""
        if self._ready:
            return
        pad = np.full(256, -1, np.int32)  # so that base + byte never leaves the arrays
        self._np = [np.concatenate((a, pad)) for a in self._arrays] + [np.array(self.scores)]
        self._base, self._check, self._value = (a.tolist() for a in self._np[:3])
        rest = "\n" if self._line_alone else ""
        self._words = re.compile(f"{MARK}*[^{MARK}{rest}]+|{MARK}+" + ("|\n" if rest else ""))
        self._own_mark = np.array([self.byte_ids[c] for c in MARK.encode()], np.int32).tobytes()
        self._as_bytes = np.array([self.byte_ids[c] for c in range(256)], np.int32)
        self._cache: dict[str, bytes] = {}
        self._ready = True

    def best_path(self, word: str) -> list[int]:
        """Ids of the best segmentation of one word (ties: the piece that starts first stays)."""
        data = word.encode()
        n = len(data)
        base, check, value, scores = self._base, self._check, self._value, self.scores
        best, come, by = [0.0] + [-1e300] * n, [-1] * (n + 1), [-1] * (n + 1)
        at = 0
        while at < n:
            lead = data[at]
            step = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, node, i, single = best[at], 0, at, False
            while i < n:
                child = base[node] + data[i]
                if check[child] != node:
                    break
                node = child
                i += 1
                piece = value[node]
                if piece >= 0:
                    score = here + scores[piece]
                    if come[i] < 0 or score > best[i]:
                        best[i], come[i], by[i] = score, at, piece
                    if i == at + step:
                        single = True
            if not single:
                i = at + step
                score = here + self.unknown
                if come[i] < 0 or score > best[i]:
                    best[i], come[i], by[i] = score, at, -1
            at += step
        out: list[int] = []
        at = n
        while at:
            if by[at] >= 0:
                out.append(by[at])
            else:
                out += [self.byte_ids[c] for c in reversed(data[come[at]:at])]
            at = come[at]
        out.reverse()
        return out

    def words_of(self, text: str) -> list[str]:
        """Marker-led words of a text whose spaces are markers."""
        return self._words.findall(text)

    def edges(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, piece) of every piece that fits somewhere in short words; piece -1: a character that none matches."""
        base, check, value, _ = self._np
        lens = np.fromiter(map(len, words), np.int64, len(words))
        size = int(lens.max())
        data = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(-1, size).astype(np.int64)
        step = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        found = []
        for at in range(size):
            rows = np.flatnonzero((lens > at) & ((data[:, at] & 0xC0) != 0x80))
            alone = np.ones(len(words), bool)
            act, node, i = rows, np.zeros(len(rows), np.int32), at
            while len(act) and i < size:
                child = base[node] + data[act, i]
                ok = (check[child] == node) & (i < lens[act])
                act, node = act[ok], child[ok].astype(np.int32)
                i += 1
                ends = value[node] >= 0
                r = act[ends]
                alone[r[step[r, at] == i - at]] = False
                found.append((r, np.full(len(r), at), np.full(len(r), i), value[node][ends].astype(np.int64)))
            left = rows[alone[rows]]
            found.append((left, np.full(len(left), at), at + step[left, at], np.full(len(left), -1)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def best_paths(self, words: list[bytes]) -> list[bytes]:
        """``best_path`` of many short words side by side; ids as packed int32."""
        base, check, value, scores = self._np
        lens = np.fromiter(map(len, words), np.int64, len(words))
        size = int(lens.max())
        data = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(-1, size).astype(np.int64)
        best = np.full((len(words), size + 1), -np.inf)
        best[:, 0] = 0
        by = np.full((len(words), size + 1), -1, np.int32)
        width = np.ones((len(words), size + 1), np.int16)   # bytes of the step that ends here
        step = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        for at in range(size):
            rows = np.flatnonzero((lens > at) & ((data[:, at] & 0xC0) != 0x80))
            here, alone = best[rows, at], np.ones(len(words), bool)
            act, node, so_far, i = rows, np.zeros(len(rows), np.int32), here, at
            while len(act) and i < size:
                child = base[node] + data[act, i]
                ok = (check[child] == node) & (i < lens[act])
                act, node, so_far = act[ok], child[ok].astype(np.int32), so_far[ok]
                i += 1
                piece = value[node]
                ends = piece >= 0
                r, score = act[ends], so_far[ends] + scores[piece[ends]]
                alone[r[step[r, at] == i - at]] = False
                better = score > best[r, i]
                r = r[better]
                best[r, i], by[r, i], width[r, i] = score[better], piece[ends][better], i - at
            left = rows[alone[rows]]
            end = at + step[left, at]
            score = best[left, at] + self.unknown
            better = score > best[left, end]
            left, end = left[better], end[better]
            best[left, end] = score[better]
            for back in range(min(4, size - at)):  # an unmatched character: one byte piece for each of its bytes
                of = left[step[left, at] > back]
                by[of, at + back + 1], width[of, at + back + 1] = -1, 1
        ids = np.zeros((len(words), size), np.int32)
        rows, pos, count = np.arange(len(words)), lens.copy(), np.zeros(len(words), np.int64)
        while len(rows):
            p = pos[rows]
            piece = by[rows, p]
            count[rows] += 1
            ids[rows, size - count[rows]] = np.where(piece >= 0, piece, self._as_bytes[data[rows, p - 1]])
            pos[rows] = p - width[rows, p]
            rows = rows[pos[rows] > 0]
        return [ids[k, size - c:].tobytes() for k, c in enumerate(count.tolist())]

    def _learn(self, words: set[str]) -> None:
        """Put the paths of all these words into the cache."""
        known = self._cache
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHE:
            self._cache = known = {w: known[w] for w in words if w in known}
        data = [w.encode() for w in new]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            known[new[i]] = np.array(self.best_path(new[i]), np.int32).tobytes()
        order = np.argsort(sizes, kind="stable")
        order = order[:int(np.searchsorted(sizes[order], LONG_WORD, "right"))]
        for lo in range(0, len(order), 8192):  # words of about one length side by side
            part = order[lo:lo + 8192].tolist()
            known.update(zip(map(new.__getitem__, part), self.best_paths([data[i] for i in part])))

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids (int32) of each text; the empty text has none."""
        self.prepare()
        split: list[list[str]] = []
        for text in texts:
            words: list[str] = []
            for i, part in enumerate(text.split(MARK)) if text else ():
                part = part.replace(" ", MARK)
                if i:
                    words.append("")  # a marker of the text's own
                else:
                    part = MARK + part
                words += self._words.findall(part)
            split.append(words)
        needed = set().union(*split)
        needed.discard("")
        self._learn(needed)
        self._cache[""] = self._own_mark
        look = self._cache.__getitem__
        return [np.frombuffer(b"".join(map(look, words)), np.int32) for words in split]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids) -> str:
        """Text of piece ids; inverse of ``encode``."""
        return b"".join(map(self.text.__getitem__, ids))[1:].decode("utf-8", "replace")


def encode_documents(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array<int>), n_tokens, round_trip (decoding gives the text back).

    Null texts are empty; empty texts have no tokens; repeated rows give repeated results; other columns are not
    read; texts of any length are taken whole; an empty table gives an empty result."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(codec)  # bounded by the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _slices(texts):
                ids = own.encode_many(texts[lo:hi])
                back = [own.decode(x.tolist()) == t for x, t in zip(ids, texts[lo:hi])]
                ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                     pa.array(np.diff(ends)), pa.array(back, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>, n_tokens int, round_trip boolean")


def _slices(texts: list[str], chars: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``chars`` characters, to bound the token arrays."""
    lo = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > chars:
            yield lo, i
            lo, held = i, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def decode_documents(encoded: DataFrame, codec: Codec) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")
