"""License scans: matching statistics of texts against a suffix automaton of license templates."""

from __future__ import annotations

import bisect
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import ALNUM, LOWER, Chunk, chunks, span_hashes
from .store import bounded_broadcast, freed

MAX_AUTOMATON_BYTES = 64 << 20
#: Words of the shortest match that counts, and the widest gap (in words, in the text or the template) inside a chain.
MIN_MATCH, MAX_GAP = 3, 4
#: Share of a template that a chain must cover: of templates under, and from, LONG words.
SHORT_COVER, LONG_COVER, LONG = 0.9, 0.6, 12

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."

#: Texts by label: short statements, the notices that go into files, and whole short licenses by their parts.
TEMPLATES: dict[str, list[str]] = {
    "agpl-3.0": ["licensed under the GNU Affero General Public License, version 3", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "artistic-2.0": ["licensed under the Artistic License 2.0", "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License"],
    "bsd": [
        _BSD_START,
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        _BSD_END,
        "licensed under the BSD License",
    ],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "cc-by-4.0": ["licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-nc-4.0": ["licensed under CC BY-NC 4.0", "Creative Commons Attribution NonCommercial 4.0 International License"],
    "cc-by-sa-4.0": ["licensed under CC BY-SA 4.0", "Creative Commons Attribution ShareAlike 4.0 International License"],
    "cc0-1.0": ["Creative Commons Zero v1.0 Universal", "the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide"],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "gpl-2.0": ["licensed under the GNU General Public License, version 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "gpl-3.0": [
        "licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        f"This program {_WARRANTY} See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "licensed under the ISC License"],
    "lgpl": ["licensed under the GNU Lesser General Public License", f"This library {_WARRANTY} See the GNU Lesser General Public License for more details.", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": [
        "Released under the MIT License",
        "licensed under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        f"{_AS_IS} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
}


def tokens(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    c = Chunk(LOWER[np.frombuffer(text.encode(), np.uint8)], np.array([0, len(text.encode())]))
    w = c.words(ALNUM)
    data = c.buf.tobytes()
    return [data[i:j] for i, j in zip(w.starts.tolist(), w.ends.tolist())]


class Automaton:
    """Suffix automaton of token sequences, joined by separators that no text holds.

    ``ends[v]`` has, for a state, the (template, end) pairs where its strings end.
    """

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.sizes = [len(s) for s in sequences]
        own: list[tuple[int, int] | None] = [None]
        last = 0
        for k, seq in enumerate(sequences):
            for i, token in enumerate([*seq, -1 - k]):
                last = self._extend(last, token, own, (k, i + 1) if i < len(seq) else None)
        found: list[set[tuple[int, int]]] = [{e} if e else set() for e in own]
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                found[self.link[v]] |= found[v]
        self.ends = [sorted(s) for s in found]

    def _extend(self, last: int, token: int, own: list, end: tuple[int, int] | None) -> int:
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        own.append(end)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            if self.length[p] + 1 == self.length[q]:
                self.link[cur] = q
            else:
                clone = len(self.next)
                self.next.append(dict(self.next[q]))
                self.length.append(self.length[p] + 1)
                self.link.append(self.link[q])
                own.append(None)
                while p >= 0 and self.next[p].get(token) == q:
                    self.next[p][token] = clone
                    p = self.link[p]
                self.link[q] = self.link[cur] = clone
        return cur

    def matches(self, run: Sequence[int], least: int) -> list[tuple[int, int, int]]:
        """Right-maximal matches of a run of tokens as (end in the run, length, state)."""
        out, v, l, nxt, link, length = [], 0, 0, self.next, self.link, self.length
        for i, token in enumerate(run):
            if token in nxt[v]:
                v, l = nxt[v][token], l + 1
                continue
            if l >= least:
                out.append((i, l, v))
            while v and token not in nxt[v]:
                v = link[v]
                l = length[v]
            if token in nxt[v]:
                v, l = nxt[v][token], l + 1
            else:
                v, l = 0, 0
        if l >= least:
            out.append((len(run), l, v))
        return out


@dataclass
class Scanner:
    automaton: Automaton
    labels: list[str]
    hashes: np.ndarray
    ids: np.ndarray
    phrases: list[tuple[str, list[int]]]

    @classmethod
    def build(cls, phrases: Mapping[str, str], templates: Mapping[str, Sequence[str]]) -> Scanner:
        vocab: dict[bytes, int] = {}
        number = lambda text: [vocab.setdefault(t, len(vocab)) for t in tokens(text)]
        base = [(label, number(p)) for p, label in phrases.items()]
        pairs = [(label, number(t)) for label, texts in templates.items() for t in texts]
        h = np.array([span_hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0] for t in vocab], np.uint64)
        order = np.argsort(h)
        return cls(Automaton([s for _, s in pairs]), [label for label, _ in pairs], h[order], order, base)

    def size(self) -> int:
        return 400 * len(self.automaton.next) + 16 * sum(map(len, self.automaton.ends)) + 16 * len(self.ids)

    def numbered(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of word hashes, -1 for words of no template."""
        some = np.zeros(1 << 16, bool)
        some[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        out = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(some[(h >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        hit = self.hashes[place] == h[at]
        out[at[hit]] = self.ids[place[hit]]
        return out

    def chains(self, found: list[tuple[int, int, int]]) -> dict[int, list[tuple[float, int, int]]]:
        """Per template its chains of (end, length, state) matches, best first: covered share, first and last word.

        Matches are chained in order of the text where both gaps are at most
        MAX_GAP; the overlap of neighbours counts once.  Chains of a template
        have no word of the text in common, so each of its copies is one.
        """
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        for end, l, v in found:
            for k, at in self.automaton.ends[v]:
                by.setdefault(k, []).append((end - l, end, at - l, at))
        out: dict[int, list[tuple[float, int, int]]] = {}
        for k, spans in by.items():
            spans.sort()
            best: list[tuple[int, int]] = []
            for i, (a, b, c, d) in enumerate(spans):
                cover, start = b - a, a
                for j in range(i - 1, -1, -1):
                    a2, b2, c2, d2 = spans[j]
                    if a - b2 > MAX_GAP + self.automaton.sizes[k]:
                        break
                    lap = max(0, b2 - a, d2 - c)
                    if b2 < b and d2 < d and a2 < a and c2 < c and a - b2 <= MAX_GAP and c - d2 <= MAX_GAP and best[j][0] + b - a - lap > cover:
                        cover, start = best[j][0] + b - a - lap, best[j][1]
                best.append((cover, start))
            taken: list[tuple[int, int]] = []
            for i in sorted(range(len(spans)), key=lambda i: (-best[i][0], spans[i])):
                (cover, start), end = best[i], spans[i][1]
                at = bisect.bisect_left(taken, (start, end))
                if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
                    taken.insert(at, (start, end))
                    out.setdefault(k, []).append((min(1.0, cover / self.automaton.sizes[k]), start, end - 1))
        return out

    def scan(self, chunk: Chunk) -> dict[str, list | np.ndarray]:
        w = chunk.lower().words(ALNUM)
        total = len(w.starts)
        num, doc = self.numbered(w.hashes()), w.doc
        n_base, first, last = np.zeros(chunk.n, np.int64), np.full(chunk.n, np.iinfo(np.int64).max), np.full(chunk.n, -1)
        base: list[set[str]] = [set() for _ in range(chunk.n)]
        for label, words in self.phrases:
            m = total - len(words) + 1
            if m <= 0 or not words:
                continue
            hit = num[:m] == words[0]
            for k in range(1, len(words)):
                hit &= num[k : k + m] == words[k]
            at = np.flatnonzero(hit)
            at = at[doc[at] == doc[at + len(words) - 1]]
            d = doc[at]
            n_base += np.bincount(d, minlength=chunk.n)
            place = at - w.first[d]
            np.minimum.at(first, d, place)
            np.maximum.at(last, d, place)
            for i in np.unique(d).tolist():
                base[i].add(label)
        # runs of template words, the only places where a match can be
        inside = num >= 0
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
        end = inside.copy()
        end[:-1] &= ~inside[1:] | (doc[1:] != doc[:-1])
        a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
        long = b - a >= MIN_MATCH
        a, b = a[long], b[long]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, j, d, f in zip(a.tolist(), b.tolist(), doc[a].tolist(), w.first[doc[a]].tolist()):
            for e, l, v in self.automaton.matches(num[i:j].tolist(), MIN_MATCH):
                found.setdefault(d, []).append((i + e - f, l, v))
        score = (n_base > 0).astype(float)
        labels = [set(s) for s in base]
        spans: list[list[dict]] = [[] for _ in range(chunk.n)]
        for d, matches in found.items():
            for k, chains in self.chains(matches).items():
                score[d] = max(score[d], chains[0][0])
                for cover, i, j in chains:
                    if cover < (SHORT_COVER if self.automaton.sizes[k] < LONG else LONG_COVER):
                        break
                    labels[d].add(self.labels[k])
                    spans[d].append({"label": self.labels[k], "first": i, "last": j, "cover": cover})
        none = n_base == 0
        return {
            "n_words": w.counts.astype(np.int64), "n_base": n_base,
            "first_word": pa.array(first, mask=none), "last_word": pa.array(last, mask=none),
            "base_labels": [",".join(sorted(s)) for s in base], "labels": [",".join(sorted(s)) for s in labels], "score": score, "spans": spans,
        }


_SPANS = T.ArrayType(T.StructType().add("label", "string").add("first", "long").add("last", "long").add("cover", "double"))


def scan_licenses(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    phrases: Mapping[str, str] | None = None,
    templates: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Places of license phrases and covered spans of license templates in every whole text.

    Returns doc_id, n_words, n_base (places of phrases), first_word and
    last_word (their least and largest start, else null), base_labels, labels
    (those of phrases and of templates covered enough; sorted, distinct, joined
    by commas, empty if none), score (1 if a phrase stands in the text, else
    the largest share of a template that a chain of matches covers) and spans
    (label, first and last word, share; every chain that covers enough of its template).  Null and
    empty texts have no words and score 0.  Null ids are passed on, repeated
    rows judged each, other columns ignored; an empty table gives no rows.  One
    pass, no shuffle; the automaton, whose size is checked, is broadcast.
    """
    scanner = Scanner.build(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    shared = bounded_broadcast(df.sparkSession, scanner, scanner.size(), MAX_AUTOMATON_BYTES)
    base = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([base.schema["doc_id"]])
    for name, kind in (("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double")):
        schema = schema.add(name, kind)
    schema = schema.add("spans", _SPANS)
    spans_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))

    def run(batches):
        s = shared.value
        for b in batches:
            for c in chunks(b.column("text")):
                got = s.scan(c)
                cols = [b.column("doc_id").slice(c.first, c.n)]
                for name in schema.names[1:]:
                    kind = {"base_labels": pa.string(), "labels": pa.string(), "spans": spans_type}.get(name)
                    cols.append(pa.array(got[name], kind) if kind else pa.array(got[name]))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return base.mapInArrow(freed(run), schema)
