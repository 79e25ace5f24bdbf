"""License texts found by patience alignment.

A text is aligned with a license template like patience diff does it: words that
occur once in both are anchors, the longest increasing subsequence of anchors is
kept, and the gaps between them are aligned the same way.  Coverage is the share
of the template's words that are aligned; COVERAGE of them make a finding.

Coverage alone cannot tell short notices or sibling licenses apart, so a template
also has phrases, the words by which it differs from its kin: a finding must have
each of them whole and unbroken ("GNU General Public License" does not hold in "GNU
Lesser General Public License", nor "CC BY 4.0" in "CC BY-SA 4.0").

A finding may hold as many foreign words as own ones: it spans twice the template's
length at most.  Around every place of a template's rare words, the cues, the text is
aligned in a narrow window first, of the template's length and a fifth on both sides,
and where that gives nothing in a wide one that holds every span allowed.  Cues are so
many that a finding has one at least.  A window that lacks too many of a template's
words to reach the coverage is not aligned, which loses nothing.  As in any patience
alignment, words that stand more than once between two anchors align only at the ends
of the stretch between them.

Long licenses are known by their notices, headers, names and SPDX tags (WORDINGS); whole
texts are read from a folder by `read_templates`, and `scan` takes any templates.  In a template, braces enclose a
phrase.

Words are runs of letters and digits, lower-cased.  Defined results: a null or
empty text has no finding (license null, coverage 0).  A text of any length is scanned
whole.  Of several findings the one with most coverage, then of the longest template,
then the first by name is a document's license; all are listed.  Repeated rows are
scanned each; an empty table gives an empty result.  Columns other than the id and the
text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COVERAGE = 0.8

#: Notices, headers and texts of public licenses.
TEMPLATES: dict[str, str] = {
    "AGPL-3.0": "Licensed under the {GNU Affero General Public License, version 3}.",
    "Apache-2.0": "Licensed under the {Apache License, Version 2.0}.",
    "Apache-2.0-header": "Licensed under the {Apache License, Version 2.0} (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD": "Released under the {BSD License}.",
    "BSD-2-Clause": "Released under the {BSD 2-Clause License}.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Released under the {BSD 3-Clause License}.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {Neither the name} of the copyright holder nor the names of its contributors may be used to {endorse or promote products} derived from this software without specific prior written permission.",
    "BSL-1.0": "Distributed under the {Boost Software License, Version 1.0}.",
    "CC-BY-4.0": "Licensed under {CC BY 4.0}.",
    "CC-BY-NC-4.0": "Licensed under {CC BY-NC 4.0}.",
    "CC-BY-NC-ND-4.0": "Licensed under {CC BY-NC-ND 4.0}.",
    "CC-BY-NC-SA-4.0": "Licensed under {CC BY-NC-SA 4.0}.",
    "CC-BY-ND-4.0": "Licensed under {CC BY-ND 4.0}.",
    "CC-BY-SA-4.0": "Licensed under {CC BY-SA 4.0}.",
    "GPL-2.0": "This work is licensed under the {GNU General Public License, version 2}.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the {GNU General Public License} as published by the Free Software Foundation; either {version 2} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0": "This work is licensed under the {GNU General Public License, version 3}.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU General Public License} as published by the Free Software Foundation, either {version 3} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Released under the {ISC License}.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, {provided that the above copyright notice} and this permission notice appear in all copies.",
    "LGPL-2.1": "This work is licensed under the {GNU Lesser General Public License, version 2.1}.",
    "LGPL-3.0": "This work is licensed under the {GNU Lesser General Public License, version 3}.",
    "MIT": "Released under the {MIT License}.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "Licensed under the {Mozilla Public License, version 2.0}.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software {released into the public domain}. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: Other wordings of the same licenses: their names where they are long enough to stand for themselves, short notices, and SPDX tags.
WORDINGS: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("{GNU Affero General Public License, version 3}", "{GNU Affero General Public License v3}", "{SPDX-License-Identifier: AGPL-3.0}"),
    "Apache-2.0": ("{Apache License, Version 2.0}", "{Apache License 2.0}", "{Apache 2.0 License}", "{SPDX-License-Identifier: Apache-2.0}"),
    "BSD-2-Clause": ("{BSD 2-Clause License}", "{2-Clause BSD License}", "{SPDX-License-Identifier: BSD-2-Clause}"),
    "BSD-3-Clause": ("{BSD 3-Clause License}", "{3-Clause BSD License}", "{SPDX-License-Identifier: BSD-3-Clause}"),
    "BSL-1.0": ("{Boost Software License, Version 1.0}", "{Boost Software License 1.0}", "{SPDX-License-Identifier: BSL-1.0}"),
    "CC-BY-4.0": ("{Creative Commons Attribution 4.0}", "{SPDX-License-Identifier: CC-BY-4.0}"),
    "CC-BY-NC-4.0": ("{Creative Commons Attribution-NonCommercial 4.0}", "{SPDX-License-Identifier: CC-BY-NC-4.0}"),
    "CC-BY-NC-ND-4.0": ("{Creative Commons Attribution-NonCommercial-NoDerivatives 4.0}", "{SPDX-License-Identifier: CC-BY-NC-ND-4.0}"),
    "CC-BY-NC-SA-4.0": ("{Creative Commons Attribution-NonCommercial-ShareAlike 4.0}", "{SPDX-License-Identifier: CC-BY-NC-SA-4.0}"),
    "CC-BY-ND-4.0": ("{Creative Commons Attribution-NoDerivatives 4.0}", "{SPDX-License-Identifier: CC-BY-ND-4.0}"),
    "CC-BY-SA-4.0": ("{Creative Commons Attribution-ShareAlike 4.0}", "{SPDX-License-Identifier: CC-BY-SA-4.0}"),
    "GPL-2.0": ("{GNU General Public License, version 2}", "{GNU General Public License v2}", "{SPDX-License-Identifier: GPL-2.0}"),
    "GPL-3.0": ("{GNU General Public License, version 3}", "{GNU General Public License v3}", "{SPDX-License-Identifier: GPL-3.0}"),
    "ISC": ("{SPDX-License-Identifier: ISC}", "Licensed under the {ISC License}"),
    "LGPL-2.1": ("{GNU Lesser General Public License, version 2.1}", "{GNU Lesser General Public License v2.1}", "{SPDX-License-Identifier: LGPL-2.1}"),
    "LGPL-3.0": ("{GNU Lesser General Public License, version 3}", "{GNU Lesser General Public License v3}", "{SPDX-License-Identifier: LGPL-3.0}"),
    "MIT": ("{SPDX-License-Identifier: MIT}", "Licensed under the {MIT License}", "or the {MIT License}", "and the {MIT License}", "terms of the {MIT License}"),
    "MPL-2.0": ("{Mozilla Public License, version 2.0}", "{Mozilla Public License 2.0}", "{SPDX-License-Identifier: MPL-2.0}"),
    "Unlicense": ("{SPDX-License-Identifier: Unlicense}", "released under the {Unlicense}"),
}

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [v], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of aligned words, in order."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if in_text[w] == 1}
        anchors = [(place[w], j) for j, w in enumerate(template[c:d], c) if in_template[w] == 1 and w in place]
        kept = [anchors[i] for i in _increasing([i for i, _ in anchors])]
        pairs += kept
        if kept:
            edges = [(a - 1, c - 1), *kept, (b, d)]
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(pairs)


@dataclass
class Template:
    name: str
    text: str
    coverage: float = COVERAGE
    words: list[str] = field(init=False)
    #: First place and length of each phrase.
    phrases: list[tuple[int, int]] = field(init=False)
    #: The words that suggest a place: those of the first phrase, or the longest ones, which are the least likely by chance.
    cues: dict[str, list[int]] = field(init=False)
    bag: Counter = field(init=False)

    def __post_init__(self):
        self.words, self.phrases = [], []
        for i, part in enumerate(re.split("[{}]", self.text)):
            more = words_of(part)
            if i % 2 and more:
                self.phrases.append((len(self.words), len(more)))
            self.words += more
        self.bag = Counter(self.words)
        size = len(self.words)
        self.need = max(1, -int(-size * self.coverage // 1))
        if self.phrases:  # one word of a phrase is enough, as no finding lacks it
            first, n = self.phrases[0]
            rare = max(range(first, first + n), key=lambda i: (len(self.words[i]), -i))
            self.cues = {self.words[rare]: [rare]}
            return
        cues, held = [], 0  # more cues than words may be missing
        for w in sorted(self.bag, key=lambda w: (-len(w), w)):
            cues.append(w)
            held += self.bag[w]
            if held > size - self.need:
                break
        self.cues = {w: [i for i, v in enumerate(self.words) if v == w] for w in cues}

    def _aligned(self, words: list[str], low: int, high: int) -> tuple[float, int, int] | None:
        """(coverage, first word, end) of a finding in words[low:high]."""
        low, high = max(0, low), min(len(words), high)
        there = Counter(w for w in words[low:high] if w in self.bag)
        if sum(min(n, there[w]) for w, n in self.bag.items()) < self.need:
            return None
        pairs = align(words[low:high], self.words)
        while len(pairs) > self.need and pairs[-1][0] - pairs[0][0] >= 2 * len(self.words):  # stray words at an end
            if pairs[1][0] - pairs[0][0] > pairs[-1][0] - pairs[-2][0]:
                pairs = pairs[1:]
            else:
                pairs = pairs[:-1]
        if len(pairs) < self.need or pairs[-1][0] - pairs[0][0] >= 2 * len(self.words):
            return None
        at = {j: i for i, j in pairs}
        for first, n in self.phrases:
            if first not in at or any(at.get(first + k) != at[first] + k for k in range(n)):
                return None
        return len(pairs) / len(self.words), low + pairs[0][0], low + pairs[-1][0] + 1

    def find(self, words: list[str], places: dict[str, list[int]]) -> list[tuple[float, int, int]]:
        """(coverage, first word, end) of findings that do not overlap, best first."""
        size = len(self.words)
        if not any(w in places for w in self.cues) or sum(min(n, len(places.get(w, ()))) for w, n in self.bag.items()) < self.need:
            return []
        slack = max(2, size // 5)
        starts = sorted({p - i for w, at in self.cues.items() for p in places.get(w, ()) for i in at})
        found: list[tuple[float, int, int]] = []
        i = 0
        while i < len(starts):
            first = last = starts[i]
            while i < len(starts) and starts[i] - first <= slack:  # starts this close share their windows
                last = starts[i]
                i += 1
            hit = self._aligned(words, first - slack, last + size + slack) or self._aligned(words, first - size, last + 2 * size)
            if hit:
                found.append(hit)
        best: list[tuple[float, int, int]] = []
        for c, a, b in sorted(found, key=lambda f: (-f[0], f[2] - f[1], f[1])):
            if all(b <= x or a >= y for _, x, y in best):
                best.append((c, a, b))
        return best


def scan_text(text: str | None, templates: list[Template]) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, first word, end, findings) for every license found, best first."""
    if not text:
        return []
    vocabulary = _vocabulary(templates)
    words = words_of(text)
    places: dict[str, list[int]] = {}
    for i in [i for i, w in enumerate(words) if w in vocabulary]:
        places.setdefault(words[i], []).append(i)
    out: dict[str, tuple] = {}
    for t in templates:
        if found := t.find(words, places):  # of a license's wordings the best one counts, and the one found most often
            hit = (-found[0][0], -len(t.words), t.name, found[0], len(found))
            held = out.get(t.name, hit)
            out[t.name] = (*min(hit, held)[:4], max(hit[4], held[4]))
    return [(name, *best, n) for _, _, name, best, n in sorted(out.values())]


def read_templates(spark, folder: str) -> dict[str, str]:
    """License texts from a folder of text files, by file name; braces in them are ordinary text."""
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    return {r["name"]: re.sub("[{}]", " ", r["value"]) for r in files.collect()}  # a table of licenses, not of documents


def _vocabulary(templates: list[Template], kept: dict = {}) -> frozenset[str]:  # noqa: B006
    key = tuple(id(t) for t in templates)
    if key not in kept:
        kept.clear()
        kept[key] = frozenset(w for t in templates for w in t.words)
    return kept[key]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, coverage, start_word, end_word, n_found and all licenses for every document."""
    known = [*TEMPLATES.items(), *((name, text) for name, more in WORDINGS.items() for text in more)] if templates is None else templates.items()
    texts = sorted((name, text) for name, text in known if words_of(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Template(n, t, coverage) for n, t in texts]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = scan_text(text, own)
                name, share, a, b, _ = found[0] if found else (None, 0.0, None, None, 0)
                rows.append((name, share, a, b, sum(f[4] for f in found), [f[0] for f in found]))
            columns = zip(*rows, strict=True) if rows else ((),) * 6
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "license", "coverage", "start_word", "end_word", "n_found", "licenses"])

    return common.map_arrow(common.id_and_text(docs, id_col, text_col), run, "doc_id long, license string, coverage double, start_word long, end_word long, n_found long, licenses array<string>")


def op4(spark, sf_dir: str) -> DataFrame:
    """doc_id, license, coverage, start_word, end_word, n_found, licenses for every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
