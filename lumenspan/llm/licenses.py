"""License scans by a positional rare-token index.

The index has each template's words with their positions: full texts of short licenses, and the notices that name the
long ones. Document frequencies of the templates' words are counted over all documents, and of each template the
places with the highest IDF vote, wherever a file has their words, for where the template would start. Postings are
intersected by relative position with gaps: votes whose starts lie as far apart as missing and inserted words can move
them count together. Where a template's votes reach the number that every match keeps, it is compared with the file
there, word by word in order, and counts only if its mandatory key phrases stand there too.

A match is a window with at least ``least`` of the template's words in order; the window is as much longer than the
template as words may be missing, so inserted words cost nothing up to that many. Which words are rare only orders the
votes: it changes work and never results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.common import slices, texts, typed

# Phrases that name a license outright, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# The texts of licenses and of the notices that name them, and the key phrases that must stand in a match.
TEMPLATES = [
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction""", ["permission is hereby granted", "without restriction"]),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""", ["permission is hereby granted", "without restriction"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ["apache license version 2"]),
    ("apache-2", """You may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0""", ["apache org licenses license 2"]),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""", ["apache license version 2"]),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met""", ["source and binary forms"]),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
        IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""", ["source and binary forms", "reproduce the above copyright notice"]),
    ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.""", ["endorse or promote products"]),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""", ["with or without fee is hereby granted"]),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that
        you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such,
        and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from
        any source distribution.""", ["must not be misrepresented"]),
    ("bsl-1", "Distributed under the Boost Software License, Version 1.0", ["boost software license"]),
    ("gpl-2", "This work is licensed under the GNU General Public License version 2", ["gnu general public license version 2"]),
    ("gpl-3", "This work is licensed under the GNU General Public License version 3", ["gnu general public license version 3"]),
    ("gpl", """You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation""", ["gnu general public license"]),
    ("gpl-2-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""", ["gnu general public license", "either version 2 of the license"]),
    ("gpl-3-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""", ["gnu general public license", "either version 3 of the license"]),
    ("lgpl", """You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published
        by the Free Software Foundation""", ["gnu lesser general public license"]),
    ("agpl", """You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published
        by the Free Software Foundation""", ["gnu affero general public license"]),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", ["mozilla public license v 2"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license v 2"]),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nc", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["attribution noncommercial"]),
    ("cc-by-sa", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["attribution sharealike"]),
    ("cc0", """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this
        work""", ["waived all copyright"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means.""", ["unencumbered software"]),
]

WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(data: bytes) -> list[bytes]:
    """Words of a lower-cased text: letters, digits and all that isn't ASCII."""
    return WORDS.findall(data.lower())


VOCABULARY = sorted({w for _, t, _ in TEMPLATES for w in words_of(t.encode())})


class Template:
    """A template's words, how many a match has (``same``), how many it may lack (``spare``), and bits of its places."""

    def __init__(self, label: str, text: str, keys: list[str], least: float):
        self.label, self.words, self.keys = label, words_of(text.encode()), [words_of(k.encode()) for k in keys]
        self.size = len(self.words)
        self.same = math.ceil(least * self.size - 1e-9)
        self.spare = self.size - self.same
        self.window = self.size + self.spare
        self.bits: dict[bytes, int] = {}
        for k, w in enumerate(self.words):
            self.bits[w] = self.bits.get(w, 0) | 1 << k
        self.needed = Counter(self.words)

    def in_order(self, words: list[bytes]) -> int:
        """The most words of the template that stand in ``words`` in order (bit-parallel common subsequence)."""
        full = (1 << self.size) - 1
        row, bits = full, self.bits
        for w in words:
            if met := bits.get(w):
                both = row & met
                row = ((row + both) | (row - both)) & full
        return self.size - row.bit_count()


class Index:
    """Template postings: word → [(template, position)] of the places that vote."""

    def __init__(self, idf: dict[bytes, float] | None = None, rarest: int = 12, least: float = 0.8, templates=TEMPLATES):
        self.templates = [Template(*t, least) for t in templates]
        self.phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]
        self.vocabulary = frozenset(w for t in self.templates for w in t.words)
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.votes = []
        for n, t in enumerate(self.templates):
            # a match may lack ``spare`` words, so at least two more places than that vote
            places = sorted(range(t.size), key=lambda k: (-(idf or {}).get(t.words[k], math.inf), k))[: max(rarest, t.spare + 2)]
            self.votes.append(max(1, len(places) - t.spare))
            for k in places:
                self.postings.setdefault(t.words[k], []).append((n, k))


def stands(words: list[bytes], phrase: list[bytes]) -> bool:
    """Whether a phrase stands in ``words``."""
    n = len(phrase)
    return any(words[k : k + n] == phrase for k in range(len(words) - n + 1))


def named(words: list[bytes], index: Index) -> list[tuple[int, str]]:
    """Starts and labels of the phrases."""
    out = []
    for phrase, label in index.phrases:
        at, n = -1, len(phrase)
        # the phrase's longest word is sought by list.index, in C
        probe = max(range(n), key=lambda k: len(phrase[k]))
        while True:
            try:
                at = words.index(phrase[probe], at + 1)
            except ValueError:
                break
            if at >= probe and words[at - probe : at - probe + n] == phrase:
                out.append((at - probe, label))
    return out


def regions(starts: list[int], votes: int, apart: int) -> Iterator[tuple[int, int]]:
    """Ranges of starts in which ``votes`` of them lie within ``apart``; ranges that meet are one."""
    starts.sort()
    lo = hi = None
    for k in range(len(starts) - votes + 1):
        a, b = starts[k], starts[k + votes - 1]
        if b - a <= apart:
            if hi is not None and a <= hi + apart:
                hi = b
            else:
                if hi is not None:
                    yield lo, hi
                lo, hi = a, b
    if hi is not None:
        yield lo, hi


def matches(words: list[bytes], index: Index) -> list[tuple[str, float, int, int]]:
    """``(label, share of the template's words, start, end)`` of the templates that stand in a file.

    Of a region the window with the most words of the template that has its key phrases; of those the first.
    """
    present = index.vocabulary.intersection(words)
    if len(present) < 2:
        return []
    alive = set()
    for n, t in enumerate(index.templates):
        if all(w in present for k in t.keys for w in k) and sum(c for w, c in t.needed.items() if w in present) >= t.same:
            alive.add(n)
    if not alive:
        return []
    voting = {w: some for w in present if (some := [(n, k) for n, k in index.postings.get(w, ()) if n in alive])}
    starts: dict[int, list[int]] = {n: [] for n in alive}
    for at, w in enumerate(words):
        if w in voting:
            for n, k in voting[w]:
                starts[n].append(at - k)
    out = []
    for n in sorted(alive):
        t = index.templates[n]
        for lo, hi in regions(starts[n], index.votes[n], 3 * t.spare):
            best = None
            for s in range(max(0, lo - 2 * t.spare), min(len(words) - 1, hi + t.spare) + 1):
                if best and best[0] == t.size:
                    break
                if words[s] not in t.bits:
                    continue  # no window begins better than at a word of the template
                window = words[s : s + t.window]
                got = t.in_order(window)
                if got >= t.same and got > (best[0] if best else 0) and all(stands(window, k) for k in t.keys):
                    best = got, s, min(len(words), s + t.size)
            if best:
                out.append((t.label, best[0] / t.size, best[1], best[2]))
    return out


def frequencies(docs: DataFrame) -> dict[bytes, int]:
    """Over all documents: how many have each word of the templates. As many rows come back as there are such words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frozenset(w for w in VOCABULARY), Counter()
        for batch in slices(batches):
            for t in texts(batch):
                counts.update(known.intersection(words_of(t)))
                counts[b""] += 1  # documents
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    found = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n"))
    return {bytes(w): n for w, n in found.collect()}


def scan(docs: DataFrame, rarest: int = 12, least: float = 0.8) -> DataFrame:
    """``doc_id, n_words, base array<struct<at, label>>, found array<struct<label, share, start, end>>`` of each row.

    Takes ``doc_id, text``; other columns are ignored. ``base`` has every place of a fixed phrase, ``found`` every
    match of a template with ``least`` of its words in order and all its key phrases, however many stand in a file and
    however common their words are. Null texts are empty and match nothing; repeated rows get a row each; an empty
    table gives an empty table.
    """
    counts = frequencies(docs)
    total = counts.pop(b"", 0)
    idf = {w: math.log(total / n) for w, n in counts.items()}
    base_type = pa.list_(pa.struct([("at", pa.int64()), ("label", pa.string())]))
    found_type = pa.list_(pa.struct([("label", pa.string()), ("share", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf, rarest, least)
        for batch in slices(batches):
            sizes, base, found = [], [], []
            for t in texts(batch):
                words = words_of(t)
                sizes.append(len(words))
                base.append([{"at": at, "label": label} for at, label in sorted(named(words, index))])
                found.append([dict(zip(("label", "share", "start", "end"), m, strict=True)) for m in sorted(matches(words, index))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(base, base_type), pa.array(found, found_type)], ["doc_id", "n_words", "base", "found"])

    spec = f"doc_id {typed(docs)}, n_words long, base array<struct<at: long, label: string>>, found array<struct<label: string, share: double, start: long, end: long>>"
    return docs.select("doc_id", "text").mapInArrow(run, spec)
