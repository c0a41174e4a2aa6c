"""License scans by a generalised suffix automaton of license tokens.

The tokens of all license notices go into one suffix automaton. A text is streamed through
it, which gives matching statistics: at every word, the longest stretch ending there that
occurs in some notice. Stretches that cannot be extended are chained where they follow one
another in text and notice alike, and a chain that covers enough of its notice is a span.

Short phrases ride in the same automaton: the states whose strings end in a phrase are marked,
so that every place of a phrase is seen while streaming, whatever longer match it is part of.

Defined results: a null or empty text has no words, spans or phrases and score 0. Rows are
judged one by one, so repeated rows repeat their result; an empty table gives an empty result. Only the id and text
columns are read, so other columns may have any names. Of chains that overlap, the one of more words is kept, then the
one of higher cover, the earlier one, the shorter one and the label first by name. A text of any length is judged whole
in one task, in time that grows with its words and, for its spans, with the notices and matches near each of them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame

from diffmill.llm.common import judged, plain_words

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
    "and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS +
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version {0} of the License, or (at your option) any later "
    "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
    "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
    "details. You should have received a copy of the GNU General Public License along with this program. "
)
#: Phrases that name a license; whole short licenses, whole standard headers, statements of one
#: line, and openings of notices, which stand in texts that do not go on.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NOTICES = (
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
     "in compliance with the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mit", _MIT),
    ("bsd", _BSD_START + _BSD_END),
    ("bsd", _BSD_START + _BSD_NAMES + _BSD_END),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
     'PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
     "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
     "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
     "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
     "SOFTWARE."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
     "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
     "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or "
     "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
     "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
     "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under "
     "copyright law. " + _AS_IS + "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
     "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
     "DEALINGS IN THE SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
     "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for "
     "any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
     "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
     "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
     "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
     "original software. 3. This notice may not be removed or altered from any source distribution."),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
     "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
     'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
     "governing permissions and limitations under the License."),
    ("gpl", _GPL.format(2)),
    ("gpl", _GPL.format(3) + "If not, see <https://www.gnu.org/licenses/>."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
     "which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this "
     "work."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
)
#: Words that a match needs to be chained, share of a notice that a chain must cover, and
#: the most words of the text that a chain may skip between two matches.
MIN_MATCH, MIN_COVER, MAX_GAP = 4, 0.7, 12

RESULT = (
    "n_words bigint, phrases array<struct<label:string,start:bigint>>, "
    "spans array<struct<label:string,start:bigint,end:bigint,cover:double>>, score double"
)


class SuffixAutomaton:
    """All stretches of several token sequences, with where each ends in each sequence."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        self.whole: list[int] = []
        for s, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].add((s, i + 1))
            self.whole.append(last)
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            self.ends[self.link[v]] |= self.ends[v]

    def _state(self, length: int, link: int, following: dict[bytes, int]) -> int:
        self.next.append(dict(following))
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, token: bytes, q: int) -> int:
        """A state for the strings of ``q`` no longer than those of ``p`` and the token."""
        if self.length[q] == self.length[p] + 1:
            return q
        short = self._state(self.length[p] + 1, self.link[q], self.next[q])
        self.link[q] = short
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = short
            p = self.link[p]
        return short

    def _extend(self, last: int, token: bytes) -> int:
        if token in self.next[last]:
            return self._split(last, token, self.next[last][token])
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, token, self.next[p][token])
        return new

    def above(self, v: int) -> Iterator[int]:
        """The state and all whose strings end its strings."""
        while v > 0:
            yield v
            v = self.link[v]


class Scanner:
    """Judges the words of one text. Built once in each task from the notices."""

    def __init__(self, phrases, notices, min_match: int, min_cover: float, max_gap: int):
        self.labels = [label for _, label in phrases] + [label for label, _ in notices]
        sequences = [plain_words(t.encode()) for t in [p for p, _ in phrases] + [n for _, n in notices]]
        self.sizes, self.n_phrases = [len(s) for s in sequences], len(phrases)
        self.automaton = SuffixAutomaton(sequences)
        self.vocabulary = {w for s in sequences for w in s}
        at = {self.automaton.whole[p]: p for p in range(self.n_phrases)}
        self.phrases_of = [
            [(at[u], self.sizes[at[u]]) for u in self.automaton.above(v) if u in at]
            for v in range(len(self.automaton.next))
        ]
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap

    def matches(self, words: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple[int, int, int]]]:
        """Places of phrases, and matches (end, length, state) that the next word does not extend."""
        following, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        phrases, found, least = [], [], self.min_match
        known = self.vocabulary
        state = n = before = 0
        for e, word in enumerate(words):
            if word not in known:
                if n >= least:
                    found.append((e, n, state))
                state = n = 0
                continue
            was, was_n = state, n
            while state and word not in following[state]:
                state = link[state]
                n = length[state]
            if n < was_n and was_n >= least:
                found.append((e, was_n, was))
            if word in following[state]:
                state, n = following[state][word], n + 1
            for p, size in self.phrases_of[state]:
                if n >= size:
                    phrases.append((self.labels[p], e + 1 - size))
            before = e + 1
        if n >= least and before == len(words):
            found.append((len(words), n, state))
        return phrases, found

    def spans(self, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains of matches, those of most words first, that overlap no better chain of the same label and are not
        within one of another label."""
        by_notice: dict[int, list[tuple[int, int, int]]] = {}
        for end, n, state in found:
            for s, at in self.automaton.ends[state]:
                if s >= self.n_phrases:
                    by_notice.setdefault(s, []).append((end - n, at - n, n))
        chains = []
        for s, parts in by_notice.items():
            parts.sort()
            best: list[tuple[int, int]] = []  # words covered, first word of the chain
            for j, (start, at, n) in enumerate(parts):
                here = (n, start)
                for i in range(j - 1, -1, -1):
                    p_start, p_at, p_n = parts[i]
                    if start - p_start > self.max_gap + self.sizes[s]:
                        break
                    # what two matches share counts once
                    shared = max(0, p_start + p_n - start, p_at + p_n - at)
                    if p_at < at and shared < n and start - p_start - p_n <= self.max_gap:
                        here = max(here, (best[i][0] + n - shared, best[i][1]), key=lambda x: (x[0], -x[1]))
                best.append(here)
                cover = min(1.0, here[0] / self.sizes[s])
                if cover >= self.min_cover:
                    chains.append((-here[0], -cover, here[1], start + n, self.labels[s]))
        kept: list[tuple[str, int, int, float]] = []
        # of each label, the kept spans in order of place; they do not overlap
        places: dict[str, tuple[list[int], list[int]]] = {}
        for _, cover, start, end, label in sorted(chains):
            starts, ends = places.setdefault(label, ([], []))
            inside = any((i := bisect_right(a, start)) and end <= b[i - 1] for a, b in places.values())
            i = bisect_left(starts, end)
            if not inside and (i == 0 or ends[i - 1] <= start):
                starts.insert(i, start)
                ends.insert(i, end)
                kept.append((label, start, end, -cover))
        return sorted(kept, key=lambda x: (x[1], x[2], x[0]))

    def __call__(self, text: bytes | None) -> dict:
        words = plain_words(text)
        phrases, found = self.matches(words)
        spans = self.spans(found) if found else []
        return {
            "n_words": len(words),
            "phrases": [{"label": label, "start": start} for label, start in phrases],
            "spans": [dict(zip(("label", "start", "end", "cover"), x)) for x in spans],
            "score": max((x[3] for x in spans), default=0.0),
        }


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES,
    min_match: int = MIN_MATCH, min_cover: float = MIN_COVER, max_gap: int = MAX_GAP,
) -> DataFrame:
    """id, n_words, phrases (label, first word), spans (label, first word, end word, cover of
    the notice) and score, the best cover. Texts are streamed task by task, without a shuffle;
    the automaton grows with the notices given, not with the texts."""

    return judged(docs, id_col, text_col, lambda: Scanner(phrases, notices, min_match, min_cover, max_gap), RESULT)
