"""License scans as an exact set-similarity join.

Text blocks and license templates are sets of tokens; a block matches a template if it has at
least ``THRESHOLD`` of the template's tokens. Blocks are the lines of a text and its paragraphs,
the runs of more than one line that have a letter or digit each, so that a notice is found however it is
wrapped; comment marks are no tokens, and a line of them alone ends a paragraph. Tokens are ordered by their number of
occurrences in the whole corpus, rarest first. With a = ceil(threshold * |T|) common tokens needed:

* prefix filter: some common token is among the first |T| - a + 1 of the template and the first
  |B| - a + 1 of the block;
* length filter: |B| >= a;
* positional filter: with the first common token at i in T and j in B, 1 + min(|T| - i - 1,
  |B| - j - 1) >= a.

What passes is verified by counting all common tokens. Tokens that no template has cannot be
common, so blocks are cut down to the templates' vocabulary first, which leaves every overlap as
it is and makes all three filters tighter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, small_batches, slices, token_hashes

THRESHOLD = 0.8

#: Notices as they stand in files, and the paragraphs of common licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "boost-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit": "Released under the MIT License.",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mpl-2.0-short": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved. No part of this publication may be reproduced without permission.",
    "reserved-short": "All rights reserved.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}

_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _WORD[_lo:_hi] = True
GAP = ~_WORD


def tokens(text: str) -> set[str]:
    """The runs of ASCII letters and digits of a text, letters as lower case."""
    return set(re.findall("[a-z0-9]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)))


def needed(size: int, threshold: float) -> int:
    """The least number of common tokens; the product is freed of rounding noise first."""
    return max(1, math.ceil(round(size * threshold, 9)))


class Vocabulary:
    """The templates' tokens by hash."""

    def __init__(self, templates: Mapping[str, str]) -> None:
        self.names = sorted(templates)
        self.sets = [tokens(templates[n]) for n in self.names]
        if not all(self.sets):
            raise ValueError("a template has no token")
        words = sorted(set().union(*self.sets))
        data = " ".join(words).encode()
        hashes, _, _ = token_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]), GAP)
        order = np.argsort(hashes)
        self.words, self.hashes = [words[i] for i in order], hashes[order]
        probe = (self.hashes >> np.uint64(44)).astype(np.int64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[probe] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are in the vocabulary, and their numbers in it."""
        maybe = np.flatnonzero(self.bits[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        sure = self.hashes[at] == hashes[maybe]
        return maybe[sure], at[sure]


def token_counts(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> dict[str, int]:
    """How often each template token occurs in all texts; as many rows as the templates have tokens."""
    vocabulary = Vocabulary(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.words), np.int64)
        for batch in batches:
            for _, data, at in slices(batch.column(0)):
                hashes, _, _ = token_hashes(data, at, GAP)
                total += np.bincount(vocabulary.find(hashes)[1], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["token", "n"])

    small_batches(docs.sparkSession)
    rows = docs.select("text").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    found = {r["token"]: r["n"] for r in rows}
    return {w: found.get(i, 0) for i, w in enumerate(vocabulary.words)}


class Index:
    """Templates in global order with their prefixes inverted."""

    def __init__(self, vocabulary: Vocabulary, counts: Mapping[str, int], threshold: float) -> None:
        self.vocabulary = vocabulary
        order = sorted(range(len(vocabulary.words)), key=lambda i: (counts.get(vocabulary.words[i], 0), vocabulary.words[i]))
        self.rank = np.zeros(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        number = {w: int(self.rank[i]) for i, w in enumerate(vocabulary.words)}
        self.size = np.array([len(s) for s in vocabulary.sets])
        self.need = np.array([needed(len(s), threshold) for s in vocabulary.sets])
        self.member = np.zeros((len(vocabulary.sets), len(order)), bool)
        entries: list[list[tuple[int, int]]] = [[] for _ in order]
        for t, s in enumerate(vocabulary.sets):
            ranks = sorted(number[w] for w in s)
            self.member[t, ranks] = True
            for i, r in enumerate(ranks[: len(ranks) - int(self.need[t]) + 1]):
                entries[r].append((t, i))
        self.start = np.cumsum([0] + [len(e) for e in entries])
        self.entry = np.array([x for e in entries for x in e], np.int64).reshape(-1, 2)

    def match(self, block: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, template, common tokens) from the (block, rank) pairs of blocks' distinct tokens, sorted."""
        none = np.zeros(0, np.int64)
        if not len(block):
            return none, none, none
        first = np.append(True, block[1:] != block[:-1])
        begin = np.flatnonzero(first)
        size = np.diff(begin, append=len(block))
        group = np.cumsum(first) - 1
        place = np.arange(len(block)) - begin[group]
        fan = self.start[token + 1] - self.start[token]
        pair = np.repeat(np.arange(len(block)), fan)
        offset = np.arange(len(pair)) - np.repeat(np.cumsum(fan) - fan, fan)
        template, i = self.entry[self.start[token[pair]] + offset].T
        g, j, need = group[pair], place[pair], self.need[template]
        length = size[g] >= need
        prefix = j <= size[g] - need
        position = 1 + np.minimum(self.size[template] - i - 1, size[g] - j - 1) >= need
        good = length & prefix & position
        pairs = np.unique(g[good] * len(self.size) + template[good])
        g, template = pairs // len(self.size), pairs % len(self.size)
        fan = size[g]
        flat = np.repeat(begin[g] - (np.cumsum(fan) - fan), fan) + np.arange(fan.sum())
        common = np.bincount(np.repeat(np.arange(len(g)), fan), self.member[np.repeat(template, fan), token[flat]], len(g)).astype(np.int64)
        good = common >= self.need[template]
        return block[begin[g[good]]], template[good], common[good]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, block, lines, template, template_tokens, common, containment) for every match.

    ``block`` is the block's first line, counted from 0, and ``lines`` the number of its lines. Two
    passes over the texts, one to count tokens and one to join; no shuffle but of the counts. Defined
    cases: null and empty texts have no match; a null ``doc_id`` is kept as null; repeated rows give
    repeated matches; tokens with one count are ordered by their letters; an empty table gives an
    empty result; other columns play no part.
    """
    vocabulary = Vocabulary(templates)
    index = Index(vocabulary, token_counts(docs, templates), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[np.ndarray] = []
            for first, data, at in slices(batch.column("text")):
                hashes, starts, _ = token_hashes(data, at, GAP, LOWER)
                hit, number = vocabulary.find(hashes)
                # the number of a token's line in the whole slice: line ends and row ends before it
                breaks = np.concatenate(([0], np.cumsum(data == 10)))
                row = np.searchsorted(at, starts, "right") - 1
                line = breaks[starts] + row
                new = np.append(True, line[1:] != line[:-1]) if len(line) else np.zeros(0, bool)
                full, owner = line[new], row[new]  # the lines with tokens
                apart = np.append(True, (full[1:] != full[:-1] + 1) | (owner[1:] != owner[:-1])) if len(full) else np.zeros(0, bool)
                head = full[apart]
                height = np.diff(np.flatnonzero(apart), append=len(full))
                part = (np.cumsum(apart) - 1)[np.cumsum(new)[hit] - 1]
                # a block's number: that of its line, and behind all lines those of paragraphs of several lines
                all_lines = int(breaks[-1]) + len(at)
                long = height[part] > 1
                owner = np.concatenate((line[hit], all_lines + part[long]))
                unique = np.unique(owner * len(vocabulary.words) + np.concatenate((index.rank[number], index.rank[number[long]])))
                block, template, common = index.match(unique // len(vocabulary.words), unique % len(vocabulary.words))
                whole = block >= all_lines
                begin, size = block.copy(), np.ones_like(block)
                begin[whole], size[whole] = head[block[whole] - all_lines], height[block[whole] - all_lines]
                base = breaks[at[:-1]] + np.arange(len(at) - 1)
                row = np.searchsorted(base, begin, "right") - 1
                rows.append(np.stack([row + first, begin - base[row], size, template, common]))
            row, block, lines, template, common = np.concatenate(rows, axis=1) if rows else np.zeros((5, 0), np.int64)
            size = index.size[template.astype(int)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(block, pa.int32()), pa.array(lines, pa.int32()), pa.array([vocabulary.names[t] for t in template], pa.string()), pa.array(size, pa.int32()), pa.array(common, pa.int32()), pa.array(common / size, pa.float64())],
                ["doc_id", "block", "lines", "template", "template_tokens", "common", "containment"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, block int, lines int, template string, template_tokens int, common int, containment double")


def scan_sql(templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same join by brute force in DuckDB."""
    values = ", ".join(f"('{n}', [{', '.join(repr(t) for t in sorted(tokens(s)))}], {needed(len(tokens(s)), threshold)})" for n, s in sorted(templates.items()))
    lower = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with templates(template, words, least) as (values {values}),
numbered as (select row_number() over () as r, doc_id, string_split(text, chr(10)) as lines from documents),
each as (select r, doc_id, unnest(range(len(lines))) as i, unnest(lines) as line from numbered),
sets as (select r, doc_id, i, list_distinct(regexp_extract_all({lower}, '[a-z0-9]+')) as have from each),
islands as (select *, i - row_number() over (partition by r order by i) as island from sets where len(have) > 0),
blocks as (select doc_id, i, 1 as lines, have from sets
  union all select any_value(doc_id), min(i), count(*), list_distinct(flatten(list(have))) from islands group by r, island having count(*) > 1),
joined as (select doc_id, i, lines, template, len(words) as size, len(list_intersect(words, have)) as n, least from blocks, templates)
select doc_id, cast(i as integer) as block, cast(lines as integer) as lines, template, cast(size as integer) as template_tokens, cast(n as integer) as common, n / size as containment
from joined where n >= least
"""
