"""License scans with a generalised suffix automaton over the words of license templates.

The automaton holds every word sequence of every template (base phrases are templates too).  Streaming a text through it
gives the matching statistics: at each word the longest template piece that ends there.  A base phrase ends
at a word if its state is the current state or one of its suffix links and the match is long enough.  Maximal
matches of at least ``SEED`` words are chained per template, forward in text and template with bounded
gaps; a chain that covers enough of a template is a span of that license.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: phrase -> label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Passages of public license texts, label -> passages.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
        "furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "released under the mit license", "licensed under the mit license"],
    "apache": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
        "basis without warranties or conditions of any kind either express or implied see the license for the specific language "
        "governing permissions and limitations under the license",
        "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no "
        "charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform "
        "sublicense and distribute the work and such derivative works in source or object form",
        "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no "
        "charge royalty free irrevocable except as stated in this section patent license to make have made use offer to sell sell import "
        "and otherwise transfer the work",
        "you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without modifications and "
        "in source or object form provided that you meet the following conditions",
        "unless required by applicable law or agreed to in writing licensor provides the work and each contributor provides its "
        "contributions on an as is basis without warranties or conditions of any kind either express or implied including without "
        "limitation any warranties or conditions of title non infringement merchantability or fitness for a particular purpose",
        "in no event and under no legal theory whether in tort including negligence contract or otherwise unless required by applicable "
        "law such as deliberate and grossly negligent acts or agreed to in writing shall any contributor be liable to you for damages"],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "you should have received a copy of the gnu general public license along with this program"],
    "lgpl": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not "
        "limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the "
        "copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
        "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage"],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential "
        "damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other "
        "tortious action arising out of or in connection with the use or performance of this software"],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed "
        "with this file you can obtain one at"],
    "cc-by": [
        "this work is licensed under a creative commons attribution 4 0 international license",
        "licensed under the creative commons attribution license", "licensed under cc by 4 0"],
    "cc0": [
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell "
        "or distribute this software either in source code form or as a compiled binary for any purpose",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in "
        "the software to the public domain"],
}

SEED = 4       # words of the shortest match that may join a chain
GAP = 12       # most words that a chain skips in text or template between two matches
COVER = 0.5    # covered share of a passage from which a chain is a license span

_FOLD = bytes((c | 0x20) if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words of the contract: A-Z lower-cased, runs of digits, letters and everything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over word ids; ``spans`` scans one text."""

    def __init__(self, base: dict[str, str] = BASE, templates: dict[str, list[str]] = TEMPLATES):
        passages = [(label, p.encode().split(), False) for label, ps in templates.items() for p in ps]
        passages += [(label, p.encode().split(), True) for p, label in base.items()]
        self.labels = [label for label, _, _ in passages]
        self.lengths = [len(w) for _, w, _ in passages]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws, _ in passages for w in ws}))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (passage, words read) at which a state's longest piece ends
        for k, (_, words, _) in enumerate(passages):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, self.vocabulary[w])
                self.ends[last].add((k, at + 1))
        by_length = sorted(range(1, len(self.length)), key=lambda s: -self.length[s])
        for s in by_length:
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]
        # base phrases that are suffixes of a state: its own and those of its links
        self.phrases: list[tuple[tuple[int, int], ...]] = [()] * len(self.length)
        whole = {}
        for k, (_, words, is_base) in enumerate(passages):
            if is_base:
                s = 0
                for w in words:
                    s = self.next[s][self.vocabulary[w]]
                whole.setdefault(s, []).append((k, len(words)))
        for s in reversed(by_length):
            self.phrases[s] = tuple(whole.get(s, ())) + (self.phrases[self.link[s]] if self.link[s] > 0 else ())

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = self._state(self.length[last] + 1, {}, -1)
        while last >= 0 and c not in self.next[last]:
            self.next[last][c] = new
            last = self.link[last]
        if last < 0:
            self.link[new] = 0
        else:
            q = self.next[last][c]
            self.link[new] = q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        return new

    def _split(self, p: int, q: int, c: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, to: dict[int, int], link: int) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.length) - 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """(base places: (passage, first word); long matches: (passage, place in it, place in text, words)).

        Words outside the vocabulary end every match, so only runs of at least two known words are streamed."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        known = np.concatenate(([False], ids >= 0, [False]))
        edge = np.flatnonzero(known[1:] != known[:-1])
        runs = edge.reshape(-1, 2)
        base: list[tuple[int, int]] = []
        long: list[tuple[int, int, int, int]] = []
        step, link, length, phrases = self.next, self.link, self.length, self.phrases
        for lo, hi in runs[runs[:, 1] - runs[:, 0] > 1].tolist():
            state = held = 0
            for at, c in enumerate(ids[lo:hi].tolist(), lo):
                if c not in step[state]:
                    if held >= SEED:
                        self._note(long, state, held, at)
                    while state and c not in step[state]:
                        state = link[state]
                    held = length[state]
                if c in step[state]:
                    state = step[state][c]
                    held += 1
                for k, n in phrases[state]:
                    if held >= n:
                        base.append((k, at - n + 1))
            if held >= SEED:
                self._note(long, state, held, hi)
        return base, long

    def _note(self, long: list, state: int, held: int, end: int) -> None:
        for k, read in self.ends[state]:
            long.append((k, read - held, end - held, held))

    def chains(self, long: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(passage, first word, end, covered share) of the chains that cover enough of their passage."""
        out = []
        open_: dict[int, list[list[int]]] = {}
        for k, place, at, n in sorted(long, key=lambda m: (m[2], m[0], m[1])):
            live = [c for c in open_.get(k, []) if at - c[1] <= GAP]
            closed = [c for c in open_.get(k, []) if at - c[1] > GAP]
            out += [(k, *c) for c in closed]
            fits = [c for c in live if c[1] <= at + n and c[2] <= place + n and place - c[2] <= GAP and place + n > c[2] and at + n > c[1]]
            if fits:
                c = max(fits, key=lambda c: c[3])
                cut = max(0, c[1] - at, c[2] - place)  # words already covered
                c[1], c[2], c[3] = at + n, place + n, c[3] + n - cut
            else:
                live.append([at, at + n, place + n, n])
            open_[k] = live
        out += [(k, *c) for k, cs in open_.items() for c in cs]
        return [(k, lo, hi, covered / self.lengths[k]) for k, lo, hi, _, covered in out if covered >= COVER * self.lengths[k]]


def scan_text(text: str, automaton: Automaton) -> dict:
    """Base places, license spans and the columns of the result for one text."""
    words = words_of(text)
    base, long = automaton.scan(words)
    spans = automaton.chains(long)
    starts = [at for _, at in base]
    base_labels = {automaton.labels[k] for k, _ in base}
    labels = base_labels | {automaton.labels[k] for k, *_ in spans}
    return {"n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)),
            "score": max([1.0] * bool(base) + [min(1.0, share) for *_, share in spans], default=0.0),
            "spans": [(automaton.labels[k], lo, hi, min(1.0, share)) for k, lo, hi, share in sorted(spans, key=lambda s: s[1:])]}


def scan_documents(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, list[str]] = TEMPLATES,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Spans are (label, first word, end, covered share).  Null texts are empty; texts without words have no
    places; repeated rows give repeated results; other columns are not read; an empty table gives an
    empty result.  The automaton is built from fixed templates, so its size is bounded by them."""
    automaton = Automaton(base, templates)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = [scan_text(t, automaton) for t in pdf["text"]]
            out = {c: pd.Series([r[c] for r in found], dtype="Int64" if c in names[:4] else object) for c in names}
            out["spans"] = pd.Series([[dict(zip(("label", "first_word", "end_word", "share"), s)) for s in r["spans"]] for r in found],
                                     dtype=object)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), **out})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(
        run, "doc_id string, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, spans array<struct<label string, first_word bigint, end_word bigint, share double>>").withColumn(
        "doc_id", F.col("doc_id").cast(kind))
