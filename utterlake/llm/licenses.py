"""License scans by patience alignment of texts with license templates.

A text's words are held against each template: words that occur exactly once in both are anchors, the
longest increasing subsequence of anchors is kept, and the gaps between them are aligned in the same
way.  The share of a template's words that are aligned is its coverage.  A text is aligned around each
place where two of a template's words follow each other, so a notice in a long text, or one that
repeats, keeps its unique words.  Words that tell licenses apart (name, version, NC or SA) must be
aligned, and none that the template lacks may stand in between.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
SCHEMA = "doc_id long, n_found long, license string, coverage double, found array<struct<license:string,start:long,end:long,coverage:double>>"

#: The words of public license notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
        the License for the specific language governing permissions and limitations under the License.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "mpl-1.1": """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not
        use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an "AS IS" basis, WITHOUT
        WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and
        limitations under the License.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
        IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: The origin of this software must not be misrepresented; you must not claim that
        you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. Altered source versions must be plainly marked as such,
        and must not be misrepresented as being the original software. This notice may not be removed or altered from any
        source distribution.""",
}

#: GNU notices: kind of work, license name, versions with the sentence that names where a copy is.
_GNU = """This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as
    published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
    This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
    of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy
    of the GNU {name} along with this {work}; if not, {where}"""
_SEE = "see https://www.gnu.org/licenses/."
_WRITE = "write to the Free Software Foundation, Inc., {}, USA."
_STREET = _WRITE.format("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301")
for _key, _work, _name, _version, _where in (
    ("gpl-1.0", "program", "General Public License", "1", _WRITE.format("675 Mass Ave, Cambridge, MA 02139")),
    ("gpl-2.0", "program", "General Public License", "2", _STREET),
    ("gpl-3.0", "program", "General Public License", "3", _SEE),
    ("lgpl-2.0", "library", "Library General Public License", "2", _STREET),
    ("lgpl-2.1", "library", "Lesser General Public License", "2.1", _STREET),
    ("lgpl-3.0", "program", "Lesser General Public License", "3", _SEE),
    ("agpl-3.0", "program", "Affero General Public License", "3", _SEE),
):
    TEMPLATES[_key] = _GNU.format(work=_work, name=_name, version=_version, where=_where)
    TEMPLATES.setdefault(f"{_key}-line", f"This work is licensed under the GNU {_name}, version {_version}.")
    TEMPLATES.setdefault(f"{_key}-short-line", f"Licensed under the GNU {_key.split('-')[0]} version {_version}.")

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
    and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
    conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}
    THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
    BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
    SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
    CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
    PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
    TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
    POSSIBILITY OF SUCH DAMAGE."""
_ENDORSE = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
    derived from this software without specific prior written permission."""
_ADVERTISE = """All advertising materials mentioning features or use of this software must display the following acknowledgement:
    This product includes software developed by the organization. """
TEMPLATES |= {"bsd-2-clause": _BSD.format(""), "bsd-3-clause": _BSD.format(_ENDORSE), "bsd-4-clause": _BSD.format(_ADVERTISE + _ENDORSE)}

for _n in "234":
    TEMPLATES[f"bsd-{_n}-clause-line"] = f"Released under the BSD {_n}-Clause License."
    TEMPLATES[f"bsd-{_n}-clause-named-line"] = f"Released under the {_n}-Clause BSD License."
TEMPLATES |= {f"apache-{_v}-line": f"Licensed under the Apache License, Version {_v}." for _v in ("1.0", "1.1")}
TEMPLATES |= {f"mpl-{_v}-line": f"Licensed under the Mozilla Public License, version {_v}." for _v in ("1.0", "1.1", "2.0")}
TEMPLATES |= {f"epl-{_v}-line": f"Licensed under the Eclipse Public License, version {_v}." for _v in ("1.0", "2.0")}
TEMPLATES |= {f"{_k}-line": f"Released under the {_n} License." for _k, _n in (("isc", "ISC"), ("zlib", "zlib"), ("boost-1.0", "Boost Software 1.0"))}
TEMPLATES |= {"cc0-1.0-line": "Released under CC0 1.0 Universal.", "boost-1.0-named-line": "Released under the Boost Software License, Version 1.0."}
for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
    for _k, _words in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives")):
        _long, _short = f"This work is licensed under a Creative Commons {_words} {_v} International License.", f"Licensed under CC {_k.upper()} {_v}."
        for _text, _kind in ((_long, "long"), (_short, "short")):
            if _text not in TEMPLATES.values():
                TEMPLATES[f"cc-{_k}-{_v}-{_kind}-line"] = _text
#: Whole texts of short licenses, and the head of a long one.
TEMPLATES |= {
    "0bsd": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
        SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
        WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
        author or authors of this software dedicate any and all copyright interest in the software to the public domain. We
        make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We
        intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
        software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "wtfpl": """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing
        it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR
        COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "boost-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
        and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
        execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to
        whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and
        this entire statement, including the above license grant, this restriction and the following disclaimer, must be
        included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such
        copies or derivative works are solely in the form of machine-executable object code generated by a source language
        processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO
        EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY,
        WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "apache-2.0-text": """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE,
        REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction,
        and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or
        entity authorized by the copyright owner that is granting the License.""",
}
#: Identifiers as files carry them.
SPDX = """0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0
    CC0-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-2.0 GPL-3.0-only GPL-3.0-or-later GPL-3.0 ISC LGPL-2.1-only LGPL-2.1-or-later
    LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense WTFPL Zlib""".split()
TEMPLATES |= {f"spdx-{_k.lower()}-line": f"SPDX-License-Identifier: {_k}" for _k in SPDX}
for _k, _v in (("GPL", "2"), ("GPL", "3"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3")):
    TEMPLATES[f"{_k.lower()}-{_v}-or-later-line"] = f"GNU {_k} v{_v} or later"
    TEMPLATES[f"{_k.lower()}-{_v}-version-or-later-line"] = f"GNU {_k} version {_v} or later"
for _one, _other in (("Apache-2.0", "MIT"), ("MIT", "Apache-2.0")):
    for _word in ("and", "or"):
        TEMPLATES[f"dual-{_one.lower()}-{_word}-{_other.lower()}-line"] = f"Dual-licensed under {_one} {_word} {_other}"
for _v in ("3.0", "4.0"):
    for _k, _words in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike")):
        TEMPLATES[f"cc-{_k}-{_v}-named-line"] = f"Creative Commons {_words} License {_v}"
#: The names without a version; a version that follows makes another license of them.
UNVERSIONED = {"apache-line": "Licensed under the Apache License.", "bsd-line": "Released under the BSD License.", "gpl-line": "This work is licensed under the GNU General Public License.", "mpl-line": "Licensed under the Mozilla Public License."}
TEMPLATES |= UNVERSIONED

#: Words that tell licenses apart: of all notices, of Creative Commons lines, and of other lines.
NAMES = frozenset("apache mit bsd gnu gpl lgpl agpl lesser affero mozilla mpl isc eclipse epl cc cc0 endorse advertising".split())
CREATIVE = frozenset("creative commons by nc nd sa attribution noncommercial non commercial sharealike share alike noderivatives noderivs".split())
LINE_NAMES = frozenset("library zlib boost".split())
SPDX_WORDS = frozenset(w for k in SPDX for w in WORD.findall(k.lower())) | {"spdx"}
NUMBER = re.compile(r"v?[0-9]+(?:\.[0-9]+)*")
VERSION_OF = frozenset("version v license licenses mpl".split())
#: A template of at most so many words is a line: all its distinguishing words must be there.
LINE = 30


def tells(words: list[str], at: int, name: str, line: bool) -> bool:
    """Whether a word tells licenses apart: a name, a number in a line, a version elsewhere."""
    w = words[at]
    if w in NAMES or line and (w in LINE_NAMES or name.startswith("cc-") and w in CREATIVE or name.startswith("spdx-") and w in SPDX_WORDS):
        return True
    return bool(NUMBER.fullmatch(w)) and (line or at > 0 and words[at - 1] in VERSION_OF)


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two word lists, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        ours, theirs = Counter(a[i:j]), Counter(b[k:m])
        place = {w: n for n, w in enumerate(a[i:j], i) if ours[w] == 1}
        anchors = [(n, place[w]) for n, w in enumerate(b[k:m], k) if theirs[w] == 1 and w in place]
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for x, (_, at) in enumerate(anchors):
            p = bisect_left(tails, at)
            back.append(ends[p - 1] if p else -1)
            tails[p : p + 1] = [at]
            ends[p : p + 1] = [x]
        run, x = [], ends[-1] if ends else -1
        while x >= 0:
            run.append(anchors[x])
            x = back[x]
        for n, at in run:  # from the last anchor to the first: the gap after each
            out.append((at, n))
            todo.append((at + 1, j, n + 1, m))
            j, m = at, n
        if run:
            todo.append((i, j, k, m))
    return sorted(out)


class Scanner:
    """Finds templates in word lists."""

    def __init__(self, templates: dict[str, str], least: float, room: float):
        self.least, self.room = least, room
        self.words = {name: WORD.findall(t.lower()) for name, t in templates.items()}
        self.pairs: dict[tuple[str, str], list[tuple[str, int]]] = {}
        for name, ws in self.words.items():
            for k, pair in enumerate(zip(ws, ws[1:], strict=False)):
                self.pairs.setdefault(pair, []).append((name, k))
        self.first = {p[0] for p in self.pairs}
        self.line = {name: len(ws) <= LINE for name, ws in self.words.items()}
        self.marks = {name: [k for k in range(len(ws)) if tells(ws, k, name, self.line[name])] for name, ws in self.words.items()}
        self.must = {name: {ws[k] for k in self.marks[name]} if self.line[name] else set() for name, ws in self.words.items()}

    def agrees(self, name: str, words: list[str], got: list[tuple[int, int]], low: int) -> bool:
        """Whether the distinguishing words are aligned and no other one stands between aligned words.

        In a notice longer than a line another word, as a misspelt one, may stand in the place of one.
        """
        line, aligned, there = self.line[name], {k for _, k in got}, {low + i for i, _ in got}
        begin, end = low + got[0][0], low + got[-1][0] + 1
        if any(i not in there and tells(words, i, name, line) for i in range(begin, end)):
            return False
        for k in self.marks[name]:
            if k in aligned:
                continue
            before, after = max((i for i, x in got if x < k), default=None), min((i for i, x in got if x > k), default=None)
            if not line and (before is None or after is None):  # cut or misspelt at an end: it counts if it is aligned elsewhere
                if not any(x in aligned and self.words[name][x] == self.words[name][k] for x in self.marks[name]):
                    return False
            elif line or after - before < 2:
                return False
        return not (name in UNVERSIONED and end < len(words) and (words[end] in ("version", "v") or NUMBER.fullmatch(words[end])))

    def __call__(self, text: str) -> list[tuple[str, int, int, float]]:
        """(license, first word, end word, coverage) of each notice, in order."""
        words = WORD.findall(text.lower())
        starts: dict[str, Counter] = {}
        for i, w in enumerate(words[:-1]):
            if w in self.first:
                for name, k in self.pairs.get((w, words[i + 1]), ()):
                    starts.setdefault(name, Counter())[i - k] += 1
        hits = []
        here = set(words) if starts else set()
        for name, at in starts.items():
            want = self.words[name]
            if not self.must[name] <= here:
                continue
            n, slack = len(want), max(2, int(len(want) * self.room))
            # a word that is not aligned breaks two pairs and a word put in breaks one, so a notice keeps at least so many
            need = n - 1 - 2 * (n - math.ceil(self.least * n)) - (n * self.room + 2)
            if need > 1:
                reach = int(n * (1 + self.room)) + 2
                order = sorted(at)
                sums = [0, *accumulate(at[p] for p in order)]
                at = [p for p in order if sums[bisect_right(order, p + reach)] - sums[bisect_left(order, p - reach)] >= need]
            done = -1
            # a group of implied starts that lie close together is one place
            places = sorted(at)
            k = 0
            while k < len(places):
                e = k
                while e + 1 < len(places) and places[e + 1] - places[e] <= slack and places[e + 1] - places[k] <= n:
                    e += 1
                low, high = max(0, places[k] - slack, done), min(len(words), places[e] + n + slack)
                k = e + 1
                got = patience(words[low:high], want)
                if not got:
                    continue
                begin, end = low + got[0][0], low + got[-1][0] + 1
                coverage = len(got) / n
                if coverage >= self.least and end - begin <= n * (1 + self.room) + 2 and self.agrees(name, words, got, low):
                    hits.append((name, begin, end, coverage))
                    done = end
        # of templates that hold the same words, the one with the most aligned words stays
        hits.sort(key=lambda h: (-h[3] * len(self.words[h[0]]), h[1], h[0]))
        kept: list[tuple[str, int, int, float]] = []  # in order of their places
        for h in hits:
            k = bisect_right(kept, h[1], key=lambda o: o[1])
            if (k == 0 or kept[k - 1][2] <= h[1]) and (k == len(kept) or kept[k][1] >= h[2]):
                kept.insert(k, h)
        return kept


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, room: float = 0.25) -> DataFrame:
    """License notices of every whole text.

    Returns one row per row: doc_id, n_found, license and coverage of the notice with the most
    aligned words (null, 0.0 without one), found (all notices with word places).  A notice covers at least
    ``least`` of its template and is at most ``room`` longer.  Null and empty texts have none.  Rows are
    independent; null ids and repeated rows stay as they are, other columns are not read, an empty
    table gives no rows.
    """
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, least, room)
        for batch in batches:
            found = [scanner(t.as_py()) for t in batch.column(1)]
            best = [max(f, key=lambda h: h[3] * len(scanner.words[h[0]]), default=(None, 0, 0, 0.0)) for f in found]
            structs = [[{"license": n, "start": s, "end": e, "coverage": c} for n, s, e, c in f] for f in found]
            kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, found), pa.int64()), pa.array([b[0] for b in best], pa.string()), pa.array([b[3] for b in best], pa.float64()), pa.array(structs, kind)], names=["doc_id", "n_found", "license", "coverage", "found"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)
