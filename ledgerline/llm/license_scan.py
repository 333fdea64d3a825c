"""License scans: an exact set-similarity join of text blocks with license templates.

A template is the set of words of a license's notice. Its containment in a block is the share of its words that
the block has. Words are ordered by how many documents of the whole corpus hold them, rarest first, and the join
is exact by these filters: a block that holds at least a share t of template T must hold one of T's first
|T| - ceil(t |T|) + 1 words in that order (prefix); it must have at least ceil(t |T|) distinct words (length);
and when the first common word found is T's k-th, at most |T| - k more can follow (position). What is left is
counted word by word. A template is not contained without the words that name it: CC BY is not CC BY-NC, and what is
licensed under GPL 4.0 by Ann is not CC BY. Of the templates contained at one place, one whose words found are a
proper part of another's gives no label: CC BY-NC is not CC BY.

A block is a line, and of a longer line every run of BLOCK_WORDS words that starts at a multiple of half that; and,
for each template, every run of twice as many words as it has, line ends or not: notices are wrapped. The templates, a fixed small list, go to the tasks whole; all else stays where the texts are.

Besides the templates, exact phrases are looked for: places where a phrase's words stand one after another.

Defined results: null and empty texts have no words, no label and score 0; copies are judged one by one; a corpus
without any template word has all frequencies 0 and ties fall back to the word itself.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .textnum import PLAIN_WORDS, Words, words

THRESHOLD = 0.8
BLOCK_WORDS = 64

#: Phrases of the registered query and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices and whole texts as licenses give them, and the words that must be among those found.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""

#: Label -> (text, words that must be among those found).
TEMPLATES: dict[str, list[tuple[str, str]]] = {
    "mit": [("released under the MIT License", "mit license"), ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "charge obtaining"), (_MIT, "charge obtaining sublicense")],
    "apache-2": [("licensed under the Apache License version 2.0", "apache license 2"), ("you may not use this file except in compliance with the License you may obtain a copy of the License at", "compliance license"), (_APACHE, "apache license 2")],
    "gpl-3": [("licensed under the GNU General Public License version 3", "gnu general public 3"), ("it under the terms of the GNU General Public License as published by the Free Software Foundation either version 3 of the License", "gnu general public 3"), (_GPL, "gnu general public 3")],
    "gpl-2": [("licensed under the GNU General Public License version 2", "gnu general public 2"), ("it under the terms of the GNU General Public License as published by the Free Software Foundation either version 2 of the License", "gnu general public 2")],
    "lgpl-3": [("licensed under the GNU Lesser General Public License version 3", "gnu lesser general public 3"), ("it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation either version 3 of the License", "gnu lesser general public 3")],
    "lgpl-2.1": [("licensed under the GNU Lesser General Public License version 2.1", "gnu lesser general public 2 1"), ("it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation either version 2.1 of the License", "gnu lesser general public 2 1")],
    "agpl-3": [("licensed under the GNU Affero General Public License version 3", "gnu affero general public 3"), ("it under the terms of the GNU Affero General Public License as published by the Free Software Foundation either version 3 of the License", "gnu affero general public 3")],
    "cc-by-nc": [("licensed under CC BY-NC 4.0", "cc by nc"), ("this work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "creative commons attribution noncommercial")],
    "cc-by-sa": [("licensed under CC BY-SA 4.0", "cc by sa"), ("this work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "creative commons attribution sharealike")],
    "cc-by-nd": [("licensed under CC BY-ND 4.0", "cc by nd"), ("this work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License", "creative commons attribution noderivatives")],
    "cc-by-nc-sa": [("licensed under CC BY-NC-SA 4.0", "cc by nc sa"), ("this work is licensed under a Creative Commons Attribution NonCommercial ShareAlike 4.0 International License", "creative commons attribution noncommercial sharealike")],
    "cc-by-nc-nd": [("licensed under CC BY-NC-ND 4.0", "cc by nc nd"), ("this work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License", "creative commons attribution noncommercial noderivatives")],
    "cc0": [("licensed under CC0 1.0 Universal", "cc0"), ("this work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal license", "cc0 public domain")],
    "cc-by": [("licensed under CC BY 4.0", "cc by"), ("this work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution")],
    "bsd": [("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution source binary")],
    "bsd-2-clause": [(_BSD_HEAD + _BSD_TAIL, "redistribution source binary")],
    "bsd-3-clause": [(_BSD_HEAD + _BSD_THIRD + _BSD_TAIL, "redistribution source binary neither endorse promote")],
    "mpl-2": [("this Source Code Form is subject to the terms of the Mozilla Public License v 2.0", "mozilla public 2"), (_MPL, "mozilla public 2")],
    "isc": [("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission fee granted"), (_ISC, "permission fee granted")],
    "unlicense": [("this is free and unencumbered software released into the public domain", "unencumbered public domain"), (_UNLICENSE, "unencumbered public domain")],
    "zlib": [(_ZLIB, "misrepresented altered")],
}
# Identifiers in the one-line form, and our label of each.
_IDENTIFIERS = {"MIT": "mit", "Apache-2.0": "apache-2", "GPL-2.0": "gpl-2", "GPL-3.0": "gpl-3", "LGPL-2.1": "lgpl-2.1", "LGPL-3.0": "lgpl-3", "AGPL-3.0": "agpl-3", "MPL-2.0": "mpl-2", "ISC": "isc", "Zlib": "zlib", "Unlicense": "unlicense", "BSD-2-Clause": "bsd-2-clause", "BSD-3-Clause": "bsd-3-clause", "CC0-1.0": "cc0", "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-ND-4.0": "cc-by-nd"}
for _id, _label in _IDENTIFIERS.items():
    # one word alone would be contained without the identifier, so every word of it must be there
    TEMPLATES[_label].append((f"SPDX-License-Identifier: {_id}", f"spdx license identifier {_id}"))


def _tokens(texts: list[str]) -> list[list[tuple[int, bytes]]]:
    out: list[list[tuple[int, bytes]]] = []
    for w in words(pa.array(texts, pa.large_string()), PLAIN_WORDS):
        raw = w.data.tobytes().lower()
        both = [(h, raw[s:e]) for h, s, e in zip(w.hash.tolist(), w.start.tolist(), w.end.tolist(), strict=True)]
        out += [both[w.first[i] : w.first[i + 1]] for i in range(w.n_texts)]
    return out


class Vocabulary:
    """Numbers 1.. for a small set of words; numbers(w) gives 0 for every other word."""

    def __init__(self, lists: list[list[tuple[int, bytes]]]):
        known = sorted({t for x in lists for t in x})
        self.words = [b for _, b in known]
        self.hashes = np.array([h for h, _ in known], np.uint64)
        self.number = {h: i + 1 for i, (h, _) in enumerate(known)}

    def numbers(self, w: Words) -> np.ndarray:
        if not hasattr(self, "quick"):
            self.quick = np.zeros(1 << 18, bool)
            self.quick[(self.hashes & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        out = np.zeros(len(w.hash), np.int64)
        if not self.words:
            return out
        maybe = np.flatnonzero(self.quick[(w.hash & np.uint64((1 << 18) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, w.hash[maybe]), len(self.hashes) - 1)
        found = self.hashes[at] == w.hash[maybe]
        out[maybe[found]] = at[found] + 1
        return out

    def document_counts(self, docs: DataFrame, text_col: str = "text") -> np.ndarray:
        """In how many documents of the whole corpus each word is: one number a word and task reaches the sum."""
        n = len(self.words) + 1

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n, np.int64)
            for b in batches:
                for w in words(b["text"], PLAIN_WORDS):
                    num = self.numbers(w)
                    at = np.flatnonzero(num)
                    pair = np.unique(w.text_of_word()[at] * n + num[at])
                    total += np.bincount(pair % n, minlength=n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total)], ["word", "n"])

        rows = docs.select(text_of(docs, text_col).alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        out = np.zeros(n, np.int64)
        for word, k in rows.collect():  # one row a template word
            out[word] = k
        return out


def lines(w: Words) -> np.ndarray:
    """Number of the line of each word; every text begins a new one."""
    breaks = np.concatenate([[0], np.cumsum(w.data == 10)])
    return breaks[w.start] + w.text_of_word()


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, list[tuple[str, str]]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 where a phrase stands, else the largest containment of a template at or over the threshold, else 0.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    phrase_words, phrase_labels = _tokens(list(phrases)), list(phrases.values())
    flat = [(label, t, must) for label, texts in templates.items() for t, must in texts]
    template_words, must_words, template_labels = _tokens([t for _, t, _ in flat]), _tokens([m for _, _, m in flat]), [x for x, _, _ in flat]
    vocabulary = Vocabulary(phrase_words + template_words + must_words)
    frequency = vocabulary.document_counts(docs, text_col)
    order = {k: i for i, k in enumerate(sorted(range(1, len(frequency)), key=lambda k: (frequency[k], k)))}
    number = vocabulary.number
    phrase_numbers = [np.array([number[h] for h, _ in p]) for p in phrase_words]
    ranked = [sorted({number[h] for h, _ in t}, key=order.__getitem__) for t in template_words]
    least = [int(np.ceil(threshold * len(t) - 1e-9)) for t in ranked]
    by_prefix: dict[int, list[tuple[int, int]]] = {}  # word -> (template, its place in the order)
    for k, t in enumerate(ranked):
        for i, x in enumerate(t[: len(t) - least[k] + 1]):
            by_prefix.setdefault(x, []).append((k, i))
    prefix_words = np.zeros(len(frequency), bool)
    prefix_words[list(by_prefix)] = True
    reach = [2 * len(t) for t in template_words]
    must = [{number[h] for h, _ in m} for m in must_words]
    in_template, in_prefix = np.zeros((2, len(ranked), len(frequency)), bool)
    for k, t in enumerate(ranked):
        in_template[k, t] = True
        in_prefix[k, t[: len(t) - least[k] + 1]] = True

    def contained(k: int, common) -> bool:
        return len(common) >= least[k] and must[k] <= common

    def runs(w: Words, num: np.ndarray, seeds: np.ndarray) -> Iterator[tuple[int, int, int, frozenset[int]]]:
        """(first word, end, template, words found) of the runs around `seeds`, each as short as its words found allow."""
        at, of = np.flatnonzero(num), w.text_of_word()
        word = num[at]
        for k in range(len(ranked)):
            s = seeds[in_prefix[k, num[seeds]]]
            if not len(s):
                continue
            lo, hi = np.maximum(s - reach[k] + 1, w.first[of[s]]), np.minimum(s + reach[k], w.first[of[s] + 1])
            apart = lo[1:] >= hi[:-1]
            lo, hi = lo[np.concatenate([[True], apart])], hi[np.concatenate([apart, [True]])]
            own = np.flatnonzero(in_template[k, word])
            place, what = at[own], word[own].tolist()
            a, b = np.searchsorted(place, lo), np.searchsorted(place, hi)
            enough = b - a >= least[k]
            place = place.tolist()
            for i, j in zip(a[enough].tolist(), b[enough].tolist(), strict=True):
                if len(set(what[i:j])) < least[k]:
                    continue
                n: Counter[int] = Counter()
                for right in range(i, j):
                    n[what[right]] += 1
                    while place[i] <= place[right] - reach[k] or n[what[i]] > 1:
                        n[what[i]] -= 1
                        if not n[what[i]]:
                            del n[what[i]]
                        i += 1
                    if contained(k, n.keys()):
                        yield place[i], place[right] + 1, k, frozenset(n)

    def join(w: Words, num: np.ndarray) -> dict[int, dict[int, float]]:
        """text -> template -> containment."""
        found: dict[int, dict[int, float]] = {}
        seeds = np.flatnonzero(prefix_words[num])
        if not len(seeds):
            return found
        line, of = lines(w), w.text_of_word()
        a, b = np.searchsorted(line, line[seeds]), np.searchsorted(line, line[seeds], "right")
        half, blocks = BLOCK_WORDS // 2, set()
        for i, lo, hi in zip(seeds.tolist(), a.tolist(), b.tolist(), strict=True):
            if hi - lo <= BLOCK_WORDS:
                blocks.add((lo, hi))
            else:
                k = (i - lo) // half
                blocks.update((lo + j * half, min(hi, lo + j * half + BLOCK_WORDS)) for j in (k - 1, k) if j >= 0)
        matches = set(runs(w, num, seeds))
        for lo, hi in blocks:
            block = set(num[lo:hi].tolist()) - {0}
            distinct = len(set(w.hash[lo:hi].tolist()))
            tried = set()
            for x in sorted(block & by_prefix.keys(), key=order.__getitem__):
                for k, i in by_prefix[x]:
                    if k in tried or distinct < least[k]:
                        continue
                    tried.add(k)
                    if len(ranked[k]) - i < least[k]:  # x is the first common word in the order
                        continue
                    common = block.intersection(ranked[k])
                    if contained(k, common):
                        matches.add((lo, hi, k, frozenset(common)))
        ordered = sorted(matches, key=lambda m: m[:3])
        starts = [m[0] for m in ordered]
        longest = max([BLOCK_WORDS, *reach])
        for lo, hi, k, common in ordered:
            own = found.setdefault(int(of[lo]), {})
            share = len(common) / len(ranked[k])
            if own.get(k, 0) >= share:
                continue
            near = ordered[bisect_left(starts, lo - longest) : bisect_left(starts, hi)]
            if not any(end > lo and common < other for _, end, _, other in near):  # a notice that says less of the same words
                own[k] = share
        return {t: own for t, own in found.items() if own}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b["text"], PLAIN_WORDS):
                n = w.n_texts
                num = vocabulary.numbers(w)
                of, last = w.text_of_word(), np.repeat(w.first[1:], w.counts())
                places, which = [], []
                for k, p in enumerate(phrase_numbers):
                    at = np.flatnonzero(num == p[0])
                    at = at[at + len(p) <= last[at]]
                    for j in range(1, len(p)):
                        at = at[num[at + j] == p[j]]
                    places.append(at)
                    which.append(np.full(len(at), k))
                at, which_ = np.concatenate(places), np.concatenate(which)
                n_base = np.bincount(of[at], minlength=n)
                lo, hi = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                np.minimum.at(lo, of[at], at - w.first[of[at]])
                np.maximum.at(hi, of[at], at - w.first[of[at]])
                base: list[set[str]] = [set() for _ in range(n)]
                for t, k in {*zip(of[at].tolist(), which_.tolist(), strict=True)}:
                    base[t].add(phrase_labels[k])
                found = join(w, num)
                labels = [",".join(sorted(base[t] | {template_labels[k] for k in found.get(t, ())})) for t in range(n)]
                score = [1.0 if base[t] else max(found.get(t, {0: 0.0}).values()) for t in range(n)]
                none = n_base == 0
                yield pa.RecordBatch.from_arrays(
                    [b["id"].slice(w.row0, n), pa.array(w.counts()), pa.array(n_base), pa.array(lo, mask=none), pa.array(hi, mask=none), pa.array([",".join(sorted(x)) for x in base]), pa.array(labels), pa.array(score)],
                    ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def license_report(docs: DataFrame) -> DataFrame:
    return scan(docs).withColumnRenamed("id", "doc_id")
