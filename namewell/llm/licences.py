"""Licence scans by a generalised suffix automaton of licence tokens.

All templates' words go into one suffix automaton.  A file is streamed through it: the state and the length of the
longest suffix that occurs in some template (matching statistics), from which every template's own longest match follows
along the suffix links.  Words that no template has end every match, so only runs of template words are walked, and
these are found on whole batches by their hashes.  A match that cannot be extended and has MIN_MATCH words at least is
placed at its occurrences in its template; matches chain while both file and template positions grow and the gap in the
file stays within MAX_GAP words.  A chain that covers MIN_COVER of its template is a span.  Of spans that overlap, the
one with more covered words stays (then that of the shorter template, the shorter span, the earlier, the template's name).

TEMPLATES holds full texts of short licences and the notices that files carry of long ones; the full texts of the GPL
family, Apache, MPL and the Creative Commons licences are not among them (pass ``templates`` to add some).

Null and empty texts give no span; very long ones are read whole; repeated rows give theirs each; ids may be null; an
empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_text
from .textkernel import words_of

MIN_MATCH, MAX_GAP, MIN_COVER = 4, 24, 0.8

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This {2} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."

TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program " + _GNU.format("", "3", "program"),
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_NAMES + _BSD_TAIL,
    "GPL-2.0": "This program " + _GNU.format("", "2", "program"),
    "LGPL-3.0": "This library " + _GNU.format("Lesser ", "3", "library"),
    "AGPL-3.0": "This program " + _GNU.format("Affero ", "3", "program"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


class Automaton:
    """A generalised suffix automaton over token lists; ``places[state]`` are the (template, last token) ends of its strings."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[set] = [set()]
        for k, tokens in enumerate(texts):
            last = 0
            for i, c in enumerate(tokens):
                last = self._extend(last, c, ends)
                ends[last].add((k, i))
        for s in sorted(range(1, len(self.len)), key=lambda s: -self.len[s]):
            ends[self.link[s]] |= ends[s]
        self.places = [sorted(e) for e in ends]

    def _new(self, length: int, ends: list[set]) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        ends.append(set())
        return len(self.len) - 1

    def _extend(self, last: int, c: int, ends: list[set]) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q, ends)
        new = self._new(self.len[last] + 1, ends)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q, ends)
        return new

    def _clone(self, p: int, c: int, q: int, ends: list[set]) -> int:
        copy = self._new(self.len[p] + 1, ends)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def walk(self, tokens: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Of every position the state and the length of the longest string that ends there and some template holds."""
        s = n = 0
        states, lengths = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int32)
        for i, c in enumerate(tokens):
            if c not in self.next[s]:
                while s and c not in self.next[s]:
                    s = self.link[s]
                n = self.len[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            else:
                s = n = 0
            states[i], lengths[i] = s, n
        return states, lengths


class Scanner:
    """Templates' words, their automaton, and what a walk through it says of every template.

    ``longest[state, k]`` is the length of the longest string of the state or of a suffix of it that template k holds, and
    ``holder[state, k]`` the state of that string, so that a template's own matching statistics come out of one walk.
    """

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        w = words_of(pa.array([templates[n] for n in self.names]))
        self.words = np.unique(w.hash)
        ids = np.searchsorted(self.words, w.hash).tolist()
        texts = [ids[a:b] for a, b in zip(w.bounds, w.bounds[1:])]
        self.sizes = [len(t) for t in texts]
        self.automaton = made = Automaton(texts)
        self.longest, self.holder = np.zeros((len(made.len), len(texts)), np.int32), np.zeros((len(made.len), len(texts)), np.int32)
        self.ends: list[dict[int, list[int]]] = [{} for _ in made.len]
        for s in sorted(range(1, len(made.len)), key=lambda s: made.len[s]):
            self.longest[s], self.holder[s] = self.longest[made.link[s]], self.holder[made.link[s]]
            for k, place in made.places[s]:
                self.longest[s, k], self.holder[s, k] = made.len[s], s
                self.ends[s].setdefault(k, []).append(place)

    def matches(self, tokens: list[int]) -> list[tuple[int, int, int, int]]:
        """(last position, length, template, state): of every template the matches of MIN_MATCH words at least that the next token does not extend."""
        states, lengths = self.automaton.walk(tokens)
        own = np.minimum(lengths[:, None], self.longest[states])
        after = np.vstack([own[1:], np.zeros((1, own.shape[1]), own.dtype)])
        at, k = np.nonzero((own >= MIN_MATCH) & (after != own + 1))
        return list(zip(at.tolist(), own[at, k].tolist(), k.tolist(), self.holder[states[at], k].tolist()))

    def spans(self, tokens: list[int], at: int) -> list[tuple[int, int, int, int]]:
        """(template, first word, last word, covered words) of the chains of one run of tokens at word ``at``.

        A match joins the chain that it makes longest; what overlaps, in the file or in the template, counts once.  Chains that no later match can
        reach are closed, so that the work follows the matches and not their square.
        """
        open_: dict[int, list] = defaultdict(list)
        done: list[tuple[int, list]] = []
        for end, n, k, state in self.matches(tokens):
            last, alive = at + end, []
            for c in open_[k]:
                if last - n - c[1] > MAX_GAP:
                    done.append((k, c))
                else:
                    alive.append(c)
            made = []
            for place in self.ends[state][k]:
                best = [last - n + 1, last, n, place]
                for c in alive:
                    cut = max(0, c[1] - last + n, c[3] - place + n)
                    if cut < n and last - n + cut - c[1] <= MAX_GAP and c[2] + n - cut > best[2]:
                        best = [c[0], last, c[2] + n - cut, place]
                made.append(best)
            # of chains that end alike in the template the one with more covered words stays open
            for c in made:
                done += [(k, x) for x in alive if x[3] == c[3] and x[2] <= c[2]]
                alive = [x for x in alive if x[3] != c[3] or x[2] > c[2]]
            open_[k] = alive + made
        done += [(k, c) for k, cs in open_.items() for c in cs]
        return [(k, c[0], c[1], c[2]) for k, c in done if c[2] >= MIN_COVER * self.sizes[k]]

    def scan(self, hashes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The spans of one text's word hashes, in order, none overlapping another."""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        inside = np.concatenate([[False], self.words[at] == hashes, [False]]) if len(hashes) else np.zeros(2, np.bool_)
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
        long = ends - starts >= MIN_MATCH
        found = []
        # runs that lie within MAX_GAP of one another chain; -1 stands for the words between
        pieces: list[tuple[int, list[int]]] = []
        last = None
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            tokens = at[a:b].tolist()
            if last is not None and a - last <= MAX_GAP:
                pieces[-1][1].extend([-1] * (a - last) + tokens)
            else:
                pieces.append((a, tokens))
            last = b
        for a, tokens in pieces:
            found += self.spans(tokens, a)
        taken: list[tuple[int, int, int, int]] = []
        starts: list[int] = []
        for f in sorted(found, key=lambda f: (-f[3], self.sizes[f[0]], f[2] - f[1], f[1], self.names[f[0]])):
            i = bisect(starts, f[2])
            if not i or taken[i - 1][2] < f[1]:
                starts.insert(i, f[1])
                taken.insert(i, f)
        return taken


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, licence, first_word, last_word, covered, coverage): a row for each span."""
    scanner = Scanner(templates or TEMPLATES)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        w = words_of(b.column(1))
        known = np.isin(w.hash, scanner.words)
        # texts without MIN_MATCH template words in a row hold no match
        streak = known.copy()
        for j in range(1, MIN_MATCH):
            streak[: len(known) - j] &= known[j:]
            streak[len(known) - j :] = False
        out = []
        for i in np.unique(np.searchsorted(w.bounds, np.flatnonzero(streak), "right") - 1):
            out += [(i, *s) for s in scanner.scan(w.hash[w.bounds[i] : w.bounds[i + 1]])]
        ids = b.column(0).take(pa.array([int(o[0]) for o in out], pa.int64()))
        col = lambda f, t: pa.array([f(o) for o in out], t)
        return pa.RecordBatch.from_arrays([ids, col(lambda o: scanner.names[o[1]], pa.string()), col(lambda o: o[2], pa.int64()), col(lambda o: o[3], pa.int64()), col(lambda o: o[4], pa.int64()), col(lambda o: o[4] / scanner.sizes[o[1]], pa.float64())], names=["doc_id", "licence", "first_word", "last_word", "covered", "coverage"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_text(rows, "text", run, "doc_id long, licence string, first_word long, last_word long, covered long, coverage double")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
