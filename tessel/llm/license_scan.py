"""License scans by conditional compression.

Candidate blocks are windows around each licensing word: for each template as
many words before and behind it as a notice of it can have, whatever lines they
are in. Templates that share too few words with their window to be confirmed
are passed over, which loses none. Each window is compressed alone and with
the template as a zstandard raw dictionary; the size saved ranks the templates.
Winners are confirmed by the exact difference of wording: words of the template
that are missing and words that stand between its own, in the alignment where
these are fewest. Of notices that overlap, the one with most words that agree
stays, on a tie the one ranked higher. Text beside a confirmed notice is looked
at again, so a window may hold several.

Edge cases: null and empty texts have no notices; repeated rows and repeated
lines are reported each; templates that save the same are tried by name; an
empty table yields an empty one; a null doc_id is kept; long texts and lines
are read whole; a notice without a licensing word left is not a candidate; extra
columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

#: Wording of licence notices as their publishers give it.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Words that make the text around them a candidate; a line may end inside a phrase.
CANDIDATE = r"(?i)licen[cs]e|copyright|redistribut|permission|public[\W_]+domain|\bgnu\b|creative[\W_]+commons|\bcc[\W_]+by\b|free[\W_]+software|apache|mozilla"
#: Share of a template's words that may differ.
MOST_DIFFERENT = 0.1
#: Share of its own compressed size that a template saves of a short block with its unaltered notice, at least; it ranks and rejects nothing.
LEAST_SAVED = 0.3

_word = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
_scanners: dict[tuple, "Scanner"] = {}


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, most_different: float = MOST_DIFFERENT):
        self.templates, self.most_different = templates, most_different
        self.words = {k: [w.lower() for w in _word.findall(v)] for k, v in templates.items()}
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.given = {k: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(v.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False) for k, v in templates.items()}
        self.size = {k: len(self.alone.compress(v.lower().encode())) for k, v in templates.items()}
        self.candidate = re.compile(CANDIDATE)
        self.counts = {k: Counter(v) for k, v in self.words.items()}
        self.most = {k: int(most_different * len(v)) for k, v in self.words.items()}

    @classmethod
    def of(cls, templates: dict[str, str], most_different: float) -> "Scanner":
        key = (tuple(sorted(templates.items())), most_different)
        if key not in _scanners:
            _scanners[key] = cls(templates, most_different)
        return _scanners[key]

    def saved(self, name: str, block: str) -> float:
        """The bytes that a template saves of the compressed block, as a share of its own compressed size."""
        data = block.lower().encode("utf-8", "replace")
        return (len(self.alone.compress(data)) - len(self.given[name].compress(data))) / self.size[name]

    def difference(self, name: str, words: list[str]) -> tuple[int, int, int]:
        """The least number of words that differ, and the first and last word of the block that belong to the template; -1, if none do."""
        own = self.words[name]
        # cost and first word that agrees, of the template's words so far against words that end here
        row = [(0, -1)] * (len(words) + 1)
        for i, x in enumerate(own, 1):
            new = [(i, -1)]
            for j, w in enumerate(words):
                if x == w:
                    n, first = row[j]
                    new.append((n, j if first < 0 else first))
                else:
                    (n, first), (m, other) = row[j + 1], new[j]
                    new.append((n + 1, first) if n <= m else (m + 1, other))
            row = new
        last = min(range(len(row)), key=lambda j: row[j][0])
        n, first = row[last]
        return (n, first, last - 1) if first >= 0 else (len(own), -1, -1)

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, float]]:
        """(template, start, end, words that differ, share saved) of every notice, in order of place."""
        if not text or not (hits := [m.start() for m in self.candidate.finditer(text)]):
            return []
        places = [m.span() for m in _word.finditer(text)]
        words = [text[a:b].lower() for a, b in places]
        starts = [a for a, _ in places]
        hits = sorted({max(0, bisect_right(starts, at) - 1) for at in hits}) if words else []
        known = {k: [0, *accumulate(w in own for w in words)] for k, own in self.counts.items()} if hits else {}
        taken: list[tuple[int, int]] = []  # words of confirmed notices, in order
        tried: dict[tuple[str, int, int], tuple | None] = {}

        def tested(name: str, lo: int, hi: int):
            need, total = len(self.words[name]) - self.most[name], known[name]
            if total[hi] - total[lo] < need or (self.counts[name] & Counter(words[lo:hi])).total() < need:
                return None
            saved = self.saved(name, text[places[lo][0] : places[hi - 1][1]])
            n, first, last = self.difference(name, words[lo:hi])
            return (n - len(self.words[name]), -saved, name, lo + first, lo + last + 1, n) if first >= 0 and n <= self.most[name] else None

        def best(hit: int):
            """The best notice in the words around the hit that no confirmed one has taken."""
            k = bisect_left(taken, (hit + 1,))
            after, before = taken[k][0] if k < len(taken) else len(words), taken[k - 1][1] if k else 0
            found = []
            for name, own in self.words.items():
                reach = len(own) + self.most[name]
                key = name, max(before, hit - reach), min(after, hit + reach + 1)
                if key not in tried:
                    tried[key] = tested(*key)
                if tried[key]:
                    found.append(tried[key])
            return min(found, default=None)

        heap = [(x, hit) for hit in hits if (x := best(hit))]
        heapq.heapify(heap)
        out: list[tuple[str, int, int, int, float]] = []
        while heap:
            (_, saved, name, first, end, n), hit = heapq.heappop(heap)
            k = bisect_left(taken, (end,))
            if k and taken[k - 1][1] > first:  # a better one has some of its words
                k = bisect_left(taken, (hit + 1,))
                if not (k and taken[k - 1][1] > hit) and (x := best(hit)):
                    heapq.heappush(heap, (x, hit))
                continue
            insort(taken, (first, end))
            out.append((name, places[first][0], places[end - 1][1], n, -saved))
            # a hit beside it may have another notice in the same window
            if not first <= hit < end and (x := best(hit)):
                heapq.heappush(heap, (x, hit))
        return sorted(out, key=lambda x: x[1])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, most_different: float = MOST_DIFFERENT) -> DataFrame:
    """doc_id, license, start, end (code points), n_different, saved: a row for each notice found."""

    def run(batches):
        scanner = Scanner.of(templates, most_different)
        for batch in batches:
            rows = [(i, *x) for i, t in zip(*(c.to_pylist() for c in batch.columns)) for x in scanner.scan(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "license", "start", "end", "n_different", "saved"])

    # texts without a licensing word stay in the JVM
    candidates = id_text(docs).filter(F.col("text").rlike(CANDIDATE))
    return candidates.mapInArrow(run, "doc_id bigint, license string, start bigint, end bigint, n_different bigint, saved double")
