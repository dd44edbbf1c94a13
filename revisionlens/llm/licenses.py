"""License scans by patience alignment.

Text and template are aligned on the words that each holds once; the longest
increasing run of those anchors is kept, equal words beside an anchor are added,
and every gap between two anchors is aligned again in the same way.  A
template's coverage is the share of its words that are aligned.

A text is only looked at where it may reach ``COVERAGE``: a template covered to that
share has at least one word of any set that makes up more than the rest of its
words (counted in whole numbers), so texts without such a word are passed over
without losing a match.  In the others, each such word of the text is put on its
place in the template, and what is before and after it is aligned alone, over at most a
template's length of added words: copies that follow each other don't hide one
another, and no work grows with the square of a text.  A word that is aligned in a sufficient place isn't tried
again.  Of each text and license the best place is reported, of equal ones the first.

Near names are told apart: versions and the words of ``TELLING`` must be aligned, and no
other word of ``TELLING`` may stand between the aligned words.  Of a template of more
than ``LONG`` words only the title has to tell.

Nulls and odd input: a null or empty text has no license; a null ``doc_id`` stays
null; repeated rows give repeated results; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisionlens.llm.common import prepare
from revisionlens.llm.license_texts import TEXTS

COVERAGE = 0.8
_PERCENT = round(100 * COVERAGE)              # shares are compared in whole numbers
_WORD = re.compile(r"[0-9a-z]+")

# Public license notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
                      "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                      "sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                  "the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}

TEMPLATES |= {
    "GPL-1.0": "This work is licensed under the GNU General Public License, version 1.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.0": "This work is licensed under the GNU Library General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GFDL-1.2": "under the terms of the GNU Free Documentation License, Version 1.2",
    "GFDL-1.3": "under the terms of the GNU Free Documentation License, Version 1.3",
    "MPL-1.1": "subject to the Mozilla Public License Version 1.1",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL-1.0": "made available under the terms of the Eclipse Public License v1.0",
    "EPL-2.0": "made available under the terms of the Eclipse Public License 2.0",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Artistic-2.0": "Licensed under the Artistic License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "ISC": "Licensed under the ISC License.",
    "Zlib": "Licensed under the zlib License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "Licensed under CC0 1.0 Universal.",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
}
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
          "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
          "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. ")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
            "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
            "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
            "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
            "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")

#: Other wordings of the licenses, and whole texts of the short ones.
PHRASINGS: dict[str, tuple[str, ...]] = {
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
            "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
            "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
            "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",),
    "ISC": (f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS}",),
    "0BSD": (f"{_GRANT}. {_AS_IS}",),
    "BSD-2-Clause": (_BSD + _BSD_END,),
    "BSD-3-Clause": (_BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
                     "specific prior written permission. " + _BSD_END,),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
             "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
             "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
             "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented "
             "as being the original software. 3. This notice may not be removed or altered from any source distribution.",),
    "BSL-1.0": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
                "(the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",),
    "Unlicense": ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
                  "commercial or non-commercial, and by any means.",),
}


def _family(lesser: str, name: str, version: str) -> None:
    """The header that the GNU licenses ask for, with its version."""
    PHRASINGS[name] = (*PHRASINGS.get(name, ()), f"you can redistribute it and/or modify it under the terms of the GNU {lesser}General Public License as published by the Free Software "
                       f"Foundation, either version {version} of the License, or (at your option) any later version")


for _lesser, _name, _version in (("", "GPL-2.0", "2"), ("", "GPL-3.0", "3"), ("Library ", "LGPL-2.0", "2"), ("Lesser ", "LGPL-2.1", "2.1"), ("Lesser ", "LGPL-3.0", "3"), ("Affero ", "AGPL-3.0", "3")):
    _family(_lesser, _name, _version)
for _code, _long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
                     ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _version, _port in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        _name, _spaced = f"CC-{_code}-{_version}", _long.replace("NonC", "Non-C").replace("ShareA", "Share-A").replace("NoD", "No-D")
        TEMPLATES.setdefault(_name, f"Licensed under CC {_code} {_version}.")
        PHRASINGS[_name] = (f"Licensed under CC {_code} {_version}.", f"This work is licensed under a Creative Commons {_long} {_version} {_port} License.",
                            f"This work is licensed under a Creative Commons {_spaced} {_version} {_port} License.", f"creativecommons.org/licenses/{_code}/{_version}")
PHRASINGS["CC0-1.0"] = ("creativecommons.org/publicdomain/zero/1.0",)

#: Words that tell licenses apart: a template's own must be aligned, and no other may stand between its aligned words.
TELLING = frozenset("mit apache mozilla mpl eclipse boost artistic bsd isc zlib cc cc0 zero general lesser library affero documentation nc sa nd noncommercial sharealike noderivatives noderivs "
                    "commercial alike derivatives derivs neither endorse appear wtfpl unencumbered".split())
#: A number after one of these words is a version.
BEFORE_VERSION = frozenset("version v by nc sa nd cc0 bsd attribution noncommercial sharealike noderivatives commercial alike derivatives zero license".split())
LONG, TITLE = 300, 12           # of a template of more than LONG words, only the first TITLE words have to tell


def words_at(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _needed(words: list[str]) -> list[str]:
    """Words of which a text that covers the template must hold one: the rarest, then longest, up to more than the share it may lack."""
    count, total, out = Counter(words), 0, []
    for w in sorted(count, key=lambda w: (count[w], -len(w), w)):
        out.append(w)
        total += count[w]
        if 100 * total > (100 - _PERCENT) * len(words):
            break
    return out


class Template:
    """One wording of a license: its words, the words of which one is needed, and the places of those that tell it apart."""

    def __init__(self, name: str, text: str):
        self.name, self.words = name, words_at(text)
        self.count, self.needed = Counter(self.words), frozenset(_needed(self.words))
        w = self.words
        self.head = len(w) if len(w) <= LONG else TITLE
        self.own = [j for j in range(self.head) if w[j] in TELLING]
        self.majors = [j for j in range(1, self.head) if w[j].isdigit() and w[j - 1] in BEFORE_VERSION]
        self.must = frozenset(w[j] for j in [*self.own, *self.majors])

    def keys(self, held: Counter) -> dict[str, list[int]]:
        """Words and their places of which every alignment has one: the rarest telling word, as it must be aligned, or the needed words."""
        if self.own:
            j = min(self.own, key=lambda j: held[self.words[j]])
            return {self.words[j]: [j]}
        return {w: [j for j, x in enumerate(self.words) if x == w] for w in self.needed}

    def enough(self, held: Counter) -> bool:
        return 100 * sum(min(c, held[w]) for w, c in self.count.items()) >= _PERCENT * len(self.words)

    def told(self, words: list[str], pairs: list[tuple[int, int]]) -> bool:
        """Whether the aligned words hold all that tell the license apart, and no other such word stands between them."""
        place = {j: i for i, j in pairs if j < self.head}
        if any(j not in place for j in self.own) or any(j not in place for j in self.majors):
            return False
        for j in self.majors:
            i = place[j]
            if j - 1 in place and i - place[j - 1] > 1 and words[i - 1] not in ("or", "and"):         # "version 2 or 3" is both
                return False
            if j + 1 < len(self.words) and self.words[j + 1].isdigit():
                follows = words[i + 1] if i + 1 < len(words) else ""
                if follows != self.words[j + 1] and (self.words[j + 1] != "0" or follows.isdigit()):
                    return False
        taken = set(place.values())
        return not any(words[i] in TELLING and i not in taken for i in range(min(taken), max(taken))) if taken else True


def parsed(templates: Mapping[str, str | Sequence[str]]) -> list[Template]:
    """Of each license its wordings; a wording without words can't be found."""
    each = [Template(name, text) for name, texts in templates.items() for text in ([texts] if isinstance(texts, str) else texts)]
    return [t for t in each if t.words]


#: What is looked for by default: every license with all its wordings.
DEFAULT: dict[str, tuple[str, ...]] = {
    name: tuple(dict.fromkeys([*([TEMPLATES[name]] if name in TEMPLATES else []), *PHRASINGS.get(name, ()), *([TEXTS[name]] if name in TEXTS else [])]))
    for name in dict.fromkeys([*TEMPLATES, *PHRASINGS, *TEXTS])}
_DEFAULT = parsed(DEFAULT)


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, v in enumerate(values):
        p = bisect.bisect_left(tops, v)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(v)
            piles.append(k)
        else:
            tops[p], piles[p] = v, k
    out = []
    k = piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b) of the patience alignment, ascending in both."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        both = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        anchors = [both[k] for k in increasing([j for _, j in both])]
        if not anchors:
            continue
        pairs.extend(anchors)
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo.extend((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True) if k > i + 1 and m > j + 1)
    return sorted(pairs)


def placed(words: list[str], template: Template, i: int, j: int) -> list[tuple[int, int]]:
    """The largest alignment that puts word ``i`` on the template's word ``j``, over few to a template's length of added words."""
    best: list[tuple[int, int]] = []
    t, n = template.words, len(template.words)
    for added in (0, n // 5 + 1, n):
        lo, hi = max(0, i - j - added), min(len(words), i + n - j + added)
        left, right = aligned(words[lo:i], t[:j]), aligned(words[i + 1:hi], t[j + 1:])
        pairs = [*((lo + x, y) for x, y in left), (i, j), *((i + 1 + x, j + 1 + y) for x, y in right)]
        if len(pairs) > len(best) and pairs[-1][0] - pairs[0][0] < 2 * n and template.told(words, pairs):
            best = pairs
        if len(best) == n:
            break
    return best


class _Window:
    """How many words of a moving part of a text a part of a template has too (each as often as it stands in both)."""

    def __init__(self, words: list[str], target: Counter):
        self.words, self.target, self.held = words, target, Counter()
        self.lo = self.hi = self.common = 0

    def moved(self, lo: int, hi: int) -> int:
        """The count for ``words[lo:hi]``; neither end moves back."""
        lo, hi = max(lo, 0), min(hi, len(self.words))
        for w in self.words[self.hi:hi]:
            if w in self.target:
                self.held[w] += 1
                self.common += self.held[w] <= self.target[w]
        for w in self.words[self.lo:lo]:
            if w in self.target:
                self.common -= self.held[w] <= self.target[w]
                self.held[w] -= 1
        self.lo, self.hi = max(self.lo, lo), max(self.hi, hi)
        return self.common


def _best(words: list[str], template: Template, keys: dict[str, list[int]], at: dict[str, list[int]]) -> tuple[int, int, int]:
    """(aligned words, first word, last word) of the best place that has one of the keys aligned.

    A word that a sufficient alignment has already put on some place isn't tried again.
    """
    best, n = (0, 0, 0), len(template.words)
    around = _Window(words, template.count)
    sides: dict[int, tuple[_Window, _Window]] = {}
    taken: set[int] = set()
    for i in sorted(i for w in keys for i in at.get(w, ())):
        if best[0] == n:
            break
        if i in taken or 100 * around.moved(i - 2 * n, i + 2 * n) < _PERCENT * n:
            continue
        for j in keys[words[i]]:
            if j not in sides:
                sides[j] = (_Window(words, Counter(template.words[:j])), _Window(words, Counter(template.words[j + 1:])))
            left, right = sides[j]
            if 100 * (1 + left.moved(i - j - n, i) + right.moved(i + 1, i + 2 * n - j)) < _PERCENT * n:
                continue
            pairs = placed(words, template, i, j)
            if len(pairs) > best[0]:
                best = (len(pairs), pairs[0][0], pairs[-1][0])
            if 100 * len(pairs) >= _PERCENT * n:
                taken.update(x for x, _ in pairs)
    return best


def scan(text: str, templates: list[Template] = _DEFAULT) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, last word) of every license that the text covers, best wording and place each."""
    words = words_at(text)
    held = Counter(words)
    maybe = [t for t in templates if t.must <= held.keys() and not t.needed.isdisjoint(held) and t.enough(held)]
    if not maybe:
        return []
    at: dict[str, list[int]] = {}
    keys = [t.keys(held) for t in maybe]
    wanted = frozenset().union(*keys)
    for i, w in enumerate(words):
        if w in wanted:
            at.setdefault(w, []).append(i)
    out: dict[str, tuple[str, float, int, int]] = {}
    for t, k in zip(maybe, keys, strict=True):
        count, first, last = _best(words, t, k, at)
        share = round(count / len(t.words), 6)
        if 100 * count >= _PERCENT * len(t.words) and (t.name not in out or share > out[t.name][1]):
            out[t.name] = (t.name, share, first, last)
    return list(out.values())


def license_matches(documents: DataFrame, templates: Mapping[str, str | Sequence[str]] | None = None) -> DataFrame:
    """One row for each document and license found: ``doc_id, license, coverage, first_word, last_word``.

    ``templates``: license and its wording or wordings; ``DEFAULT`` if not given.
    """
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordings = _DEFAULT if templates is None else parsed(templates)
        for batch in batches:
            found = [(d.as_py(), *hit) for d, t in zip(batch.column(0), batch.column(1), strict=True) for hit in scan(t.as_py() or "", wordings)]
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)],
                                  names=["doc_id", "license", "coverage", "first_word", "last_word"])

    return docs.mapInArrow(scanned, "doc_id long, license string, coverage double, first_word long, last_word long")
