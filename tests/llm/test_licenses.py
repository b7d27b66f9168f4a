import random
import time
from collections import Counter

from utterlake.llm import licenses as L

from .fixtures import documents, odd_documents


def test_patience_against_its_definition():
    r = random.Random(4)
    for _ in range(500):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randint(0, 12))] for _ in range(2))
        got = L.patience(a, b)
        assert all(a[i] == b[k] for i, k in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
    for _ in range(200):  # all words unique: anchors are a longest increasing subsequence
        a = r.sample("abcdefgh", 8)
        longest = [1] * 8
        for i in range(8):
            longest[i] = max([longest[k] + 1 for k in range(i) if a[k] < a[i]], default=1)
        assert len(L.patience(a, sorted(a))) >= max(longest)
    assert L.patience(list("xabcy"), list("abc")) == [(1, 0), (2, 1), (3, 2)]
    assert L.patience(list("abcd"), list("acbd")) in ([(0, 0), (1, 2), (3, 3)], [(0, 0), (2, 1), (3, 3)])


def test_planted_notices(spark):
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(500)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows, want = [], {}
    for d, (name, text) in enumerate([x for x in L.TEMPLATES.items() for _ in range(6)]):
        words = text.split()
        if len(words) > 30:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((d, f"{prose(r.randint(0, 3000))}\n{' '.join(words)}\n{prose(r.randint(0, 300))}", None, None, None))
        want[d] = name
    line = L.TEMPLATES["mit-line"]
    rows += [(9000, f"{line}\n{prose(30)}\n{line} {L.TEMPLATES['apache-2.0-line']}", None, None, None)]
    rows += [(10000 + i, prose(400), None, None, None) for i in range(20)]
    got = {x.doc_id: x for x in L.scan(documents(spark, rows)).collect()}
    assert {d: got[d].license for d in want} == want
    assert [f.license for f in got[9000].found] == ["mit-line", "mit-line", "apache-2.0-line"]
    assert all(got[10000 + i].n_found == 0 and got[10000 + i].license is None for i in range(20))


def test_near_misses():
    scanner = L.Scanner(L.TEMPLATES, 0.8, 0.25)
    found = lambda text: [h[0] for h in scanner(f"some words {text} and more words")]
    for text, want in (
        ("Released under the BSD License.", ["bsd-line"]),
        ("Licensed under CC BY 4.0", ["cc-by-4.0-short-line"]),
        ("Licensed under CC BY-NC-SA 4.0", ["cc-by-nc-sa-4.0-short-line"]),
        ("Licensed under CC BY-NC 3.0", ["cc-by-nc-3.0-short-line"]),
        ("Licensed under the Apache License, Version 1.1", ["apache-1.1-line"]),
        ("Licensed under the Apache License", ["apache-line"]),
        ("Licensed under the Apache License, Version 3.7", []),
        ("Licensed under the Artful License, Version 2.0", []),
        ("Released under the Foo License.", []),
        ("This work is licensed under the GNU General Public License, version 4.", []),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["lgpl-3.0-line"]),
        ("This work is licensed under the GNU Lesser General Public License, version 4.", []),
        (L.TEMPLATES["gpl-3.0"].replace("version 3", "version 4"), []),
        (L.TEMPLATES["gpl-3.0"].replace("version 3 of", "of"), []),
        (L.TEMPLATES["gpl-3.0"].replace("GNU General", "GNU Lesser General"), ["lgpl-3.0"]),
        (L.TEMPLATES["bsd-3-clause"], ["bsd-3-clause"]),
        ("Distributed under the MIT license", ["mit-line"]),
    ):
        assert found(text) == want, text


def test_odd_rows(spark):
    got = L.scan(documents(spark)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, *_ in odd_documents())
    assert L.scan(documents(spark).limit(0)).collect() == []


def plain_alignment(words, want):
    """Longest common subsequence: no alignment holds more words."""
    row = [0] * (len(want) + 1)
    for w in words:
        before = 0
        for k, x in enumerate(want, 1):
            before, row[k] = row[k], before + 1 if w == x else max(row[k], row[k - 1])
    return row[-1]


def test_coverage_against_a_plain_alignment():
    """Of notices with words left out, put in and changed: found where the plain alignment covers enough, and never above it."""
    r = random.Random(6)
    scanner = L.Scanner(L.TEMPLATES, 0.8, 0.25)
    found = 0
    for name in ("mit", "apache-2.0", "bsd-3-clause", "isc", "zlib", "gpl-3.0", "mpl-2.0"):
        for _ in range(12):
            words = L.WORD.findall(L.TEMPLATES[name].lower())
            for _ in range(r.randint(0, len(words) // 8)):
                at, what = r.randrange(len(words)), r.random()
                if not L.tells(words, at, name, False):
                    words[at : at + 1] = [] if what < 0.3 else ["x" * r.randint(3, 9)] if what < 0.6 else [words[at], "y" * r.randint(3, 9)]
            text = " ".join([*("before" for _ in range(r.randint(0, 30))), *words, *("after" for _ in range(r.randint(0, 30)))])
            best = plain_alignment(L.WORD.findall(text), scanner.words[name]) / len(scanner.words[name])
            got = [h for h in scanner(text) if h[0] == name]
            assert all(h[3] <= best + 1e-9 for h in got)
            if best >= 0.87:
                assert len(got) == 1 and got[0][3] >= best - 0.08, (name, best, got)
                found += 1
    assert found > 50


def test_many_notices_in_one_text():
    text = " ".join(["Released under the MIT License. Some words between them."] * 20_000)
    began = time.perf_counter()
    assert len(L.Scanner(L.TEMPLATES, 0.8, 0.25)(text)) == 20_000
    assert time.perf_counter() - began < 60


def test_whole_texts_identifiers_and_dual_lines():
    scan = L.Scanner(L.TEMPLATES, 0.8, 0.25)
    name = lambda text: [h[0] for h in scan(text)]
    for key in ("0bsd", "isc", "unlicense", "wtfpl", "boost-1.0", "mit", "apache-2.0-text"):
        assert name("some words before. " + L.TEMPLATES[key] + " and some after it") == [key], key
    assert name("# SPDX-License-Identifier: Apache-2.0") == ["spdx-apache-2.0-line"]
    assert name("// SPDX-License-Identifier: GPL-3.0-or-later") == ["spdx-gpl-3.0-or-later-line"]
    assert name("SPDX-License-Identifier: GPL-3.0-only code") == ["spdx-gpl-3.0-only-line"]
    assert name("SPDX-License-Identifier: BSD-3-Clause") == ["spdx-bsd-3-clause-line"] and name("SPDX-License-Identifier: 0BSD") == ["spdx-0bsd-line"]
    assert name("Dual-licensed under Apache-2.0 and MIT") == ["dual-apache-2.0-and-mit-line"]
    assert name("GNU GPL v3 or later") == ["gpl-3-or-later-line"] and name("GNU LGPL v3 or later") == ["lgpl-3-or-later-line"] and name("GNU GPL v2 or later") == ["gpl-2-or-later-line"]
    assert name("Creative Commons Attribution-ShareAlike License 4.0") == ["cc-by-sa-4.0-named-line"]
    assert name("SPDX-License-Identifier: Nothing-1.0") == [] and name("the license identifier of a car") == []
