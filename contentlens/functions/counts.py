"""Words, sentences and syllables of whole batches of texts, counted by array operations.

The rules are those of ``text.word_count``, ``text.sentence_count`` and ``text.syllable_count``; the three regex scans of each
text become one look-up of its code points.  A task holds one Arrow batch and the code points of ``PART`` bytes or one text.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from . import text as X
from .resources import VOWELS

PART = 1 << 20
#: The white space of ``text.SPACES``, by code point.
SPACES = (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
OTHER, SPACE, END, VOWEL = range(4)


@cache
def _kinds() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    kinds[list(SPACES)] = SPACE
    kinds[[ord(c) for c in ".!?"]] = END
    kinds[[ord(c) for c in VOWELS]] = VOWEL
    return kinds


def _count(texts: pa.StringArray) -> list[np.ndarray]:
    """(words, sentences, syllables) of lower-cased texts without nulls."""
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1]
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, np.uint8)[ends[0]:ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    if not len(raw):
        return [np.zeros(n, np.int64)] * 3
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.flatnonzero((raw & 0xC0) != 0x80) if len(codes) < len(raw) else None  # the first byte of each code point
    bounds = ends - ends[0] if starts is None else np.searchsorted(starts, ends - ends[0])
    kind = _kinds()[codes]
    first = np.zeros(len(kind) + 1, bool)  # the first code point of a text
    first[bounds] = True
    first = first[:-1]

    def begins(of: np.ndarray, at_first: np.ndarray) -> np.ndarray:
        """Where a run of ``of`` begins within a text."""
        return of & np.append(True, ~of[:-1] | at_first[1:])

    def times(places: np.ndarray) -> np.ndarray:
        """How many of the ascending places lie in each text."""
        return np.diff(np.searchsorted(places, bounds))

    visible, vowel = kind != SPACE, kind == VOWEL
    word = np.flatnonzero(begins(visible, first))
    # a vowelless word adds one syllable: words less those that hold a vowel
    groups = np.flatnonzero(begins(vowel, first))
    voiced = np.unique(np.searchsorted(word, groups, "right")) - 1
    words = times(word)
    # a sentence begins at a visible character that is no end, after an end or as the first such character
    seen = np.flatnonzero(visible)
    inner = kind[seen] != END
    lead = np.zeros(len(seen) + 1, bool)
    lead[np.searchsorted(seen, bounds)] = True
    sentences = times(seen[begins(inner, lead[:-1])])
    return [words, sentences, times(groups) + words - times(word[voiced])]


@arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in ("words", "sentences", "syllables")]))
def _counted(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    found, lo = [[np.zeros(0, np.int64)] * 3], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, int(ends[lo]) + PART, "right")) - 1)
        found.append(_count(texts.slice(lo, hi - lo)))
        lo = hi
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found)], ["words", "sentences", "syllables"])


def text_counts(c) -> Column:
    """struct(words, sentences, syllables) of a text; null texts count as empty."""
    return _counted(F.lower(X.text_or_empty(c)))
