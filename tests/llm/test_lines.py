import random
from collections import Counter

import xxhash

from utterlake.llm import lines

from .fixtures import documents


def near(a, b):
    """Whether two strings are within one edit."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, exact_below):
    """Documents in the order of ids (null last), of one id in the order of the text's hash; each line against all before it."""
    last = 2**63 - 1
    signed = lambda t: (h := xxhash.xxh64_intdigest(t, seed=42)) - 2**64 * (h >= 2**63)
    counts = Counter(d for d, _ in rows)
    order = sorted(range(len(rows)), key=lambda k: (last if rows[k][0] is None else rows[k][0], signed(rows[k][1] or "") if counts[rows[k][0]] > 1 else 0, k))
    seen, out = [], Counter()
    for k in order:
        d, t = rows[k]
        own = (t or "").split("\n")
        left = []
        for x in own:
            if not x.strip(" \t\r\x0b\x0c"):
                left.append(x)
                continue
            if not any(x == y or max(len(x), len(y)) >= exact_below and near(x, y) for y in seen):
                left.append(x)
            seen.append(x)
        out[d, "\n".join(left), len(own), len(left)] += 1
    return out


def random_rows(seed):
    r = random.Random(seed)
    known = ["".join(r.choice("ab é") for _ in range(r.randint(0, 16))) for _ in range(30)]
    rows = []
    for d in range(60):
        own = []
        for _ in range(r.randint(0, 6)):
            x = r.choice(known)
            if r.random() < 0.5 and x:
                i = r.randrange(len(x))
                x = r.choice([x[:i] + x[i + 1 :], x[:i] + "c" + x[i:], x[:i] + "ü" + x[i + 1 :]])
            own.append(x)
        rows.append((d, "\n".join(own) if own else None, None, None, None))
    odd = [(None, "\n".join(known[:3])), (None, known[5] + "\nown line one"), (None, known[5] + "\nown line two"), (None, "new null line"), (None, "new null line"), (None, None)]
    odd += [(7, "seven one\n" + known[1]), (7, "seven two\n" + known[1]), (7, "seven two\n" + known[1]), (8, "\t\n \n")]
    return [*rows, *((d, t, None, None, None) for d, t in odd)]


def test_lines_against_brute_force(spark):
    for seed in range(2):
        rows = random_rows(seed)
        got = Counter(map(tuple, lines.dedup_lines(documents(spark, rows), exact_below=6).collect()))
        assert got == brute([(d, t) for d, t, *_ in rows], 6)
    assert Counter(map(tuple, lines.dedup_lines(documents(spark, rows), exact_below=10**9).collect())) == brute([(d, t) for d, t, *_ in rows], 10**9)


def test_short_lines_and_rows_without_ids(spark):
    rows = [(1, "All rights reserved."), (2, "All rights reserved.\nx"), (3, "all rights reserved.\nx"), (None, "All rights reserved."), (None, "other"), (4, "y" * 31), (5, "y" * 32), (6, "y" * 30)]
    got = Counter((r.doc_id, r.text, r.n_kept) for r in lines.dedup_lines(documents(spark, [(*r, None, None, None) for r in rows])).collect())
    assert got == Counter([(1, "All rights reserved.", 1), (2, "x", 1), (3, "all rights reserved.", 1), (None, "", 0), (None, "other", 1), (4, "y" * 31, 1), (5, "", 0), (6, "y" * 30, 1)])


def test_a_long_line(spark):
    long = "".join(random.Random(1).choices("abcdefgh ", k=120_000))
    got = {r.doc_id: r.n_kept for r in lines.dedup_lines(documents(spark, [(1, long, None, None, None), (2, long[:60_000] + "X" + long[60_000:], None, None, None), (3, long[::-1], None, None, None)])).collect()}
    assert got == {1: 1, 2: 0, 3: 1}


def test_variants_are_the_hashes_of_what_is_left():
    x = "a bé\U0001f600c"
    got = lines.variants(x)
    assert got[0] != got[1]
    for i in range(len(x)):
        assert got[i + 1] == lines.variants(x[:i] + x[i + 1 :])[0]
    assert len(lines.variants("a")) == 2


def test_empty_table(spark):
    assert lines.dedup_lines(documents(spark, []).limit(0)).collect() == []
