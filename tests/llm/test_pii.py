import hashlib
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from utterlake.llm import pii

from .fixtures import documents, odd_documents

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_against_plain_patterns():
    r = random.Random(1)
    pieces = ["a.b@c.de", "@", "x@y", "a@b.c@d.e", "1.2.3.4", "300.1.1.1", "001.2.3.4.5", "4539 1488 0343 6467", "4539148803436467", "+1 (555) 123-4567", "+12", " ", "é", ".", "-", "0", "12345678901234", "\n", "word"]
    for _ in range(4000):
        t = "".join(r.choice(pieces) for _ in range(r.randint(0, 8)))
        assert pii.base_spans(t) == brute(t), t


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"my phone number is +1 555 010 {1000 + i} thanks {i % 7}", None, None, None) for i in range(12)]
    rows += [(100, "my phone number is 00445550199 thanks", None, None, None), (101, "the total is 99887766 units", None, None, None), (102, "call 00445550199 now", None, None, None)]
    out = {r.doc_id: r for r in pii.find(documents(spark, rows)).collect()}
    assert out[100].spans == "phone:19:30" and out[100].n_phone == 0
    assert out[102].spans == "phone:5:16"
    assert out[101].spans == ""
    assert out[0].spans == "phone:19:34"


def test_identifiers_in_groups(spark):
    rows = [(i, f"my phone number is +1 555 010 {1000 + i} thanks {i % 7}", None, None, None) for i in range(24)]
    more = ["020 7946 0958", "(052) 555-0934", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]
    rows += [(100 + i, f"my phone number is {x} thanks", None, None, None) for i, x in enumerate(more)]
    out = {r.doc_id: r for r in pii.find(documents(spark, rows)).collect()}
    for i, x in enumerate(more):
        assert out[100 + i].spans == f"phone:19:{19 + len(x)}" and out[100 + i].n_phone == 0, x


def test_rounds_end_when_nothing_changes(spark):
    """A chain: each value links its context with the next one's, over more than three rounds."""
    rows = [(i, f"seed tag +1 555 010 {1000 + i}", None, None, None) for i in range(3)]
    for step in range(6):
        before = "seed tag" if step == 0 else f"link{step}a tag"
        for k in range(3):
            rows += [(1000 + 10 * step + k, f"{before} {90000 + 10 * step + k}", None, None, None), (2000 + 10 * step + k, f"link{step + 1}a tag {90000 + 10 * step + k}", None, None, None)]
    # three known values against three unknown ones: a share of a half is enough here
    out = pii.find(documents(spark, rows), confident=0.3).collect()
    assert all(r.spans.startswith("phone:") for r in out if r.doc_id >= 1000), [(r.doc_id, r.spans) for r in out]


def test_every_row(spark):
    rows = [*odd_documents(), (9000, "mail a.b@c.de, 1.2.3.4 4539148803436467", None, None, None)]
    want = Counter((d, hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute(t or "")).encode()).hexdigest()) for d, t, *_ in rows)
    got = pii.find(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    assert pii.find(documents(spark, rows).limit(0)).collect() == []


def test_redact():
    t = "mail a.b@c.de now"
    assert pii.redact(t, pii.shown(pii.base_spans(t))) == "mail [EMAIL] now"
    assert pii.redact(t, "") == t


def test_scans_are_linear_and_take_any_token():
    assert pii.base_spans("0" * 5000 + ".1.1.1 " + "7" * 5000 + ".1.1.1") == [(0, 1, 5006)]
    began = time.perf_counter()
    for text in ("1" * 10**6, "a" * 10**6 + "1", "é" * 10**6 + " 5", "@" * 10**6, "+(" * 10**5, "1." * 10**5, "a at " * 10**5, "7|" * 10**5):
        pii.scan_text(text)
    assert time.perf_counter() - began < 60


def brute_discover(texts, confident, support):
    """The rounds of the pattern graph over plain dictionaries."""
    seeds, edges, small = {}, {}, Counter()
    for t in set(texts):
        found = pii.scan_text(t)[1]
        small.update(pii.background(t, found))
        for x in found:
            for p in x["patterns"]:
                k, r = edges.get((p, x["value"]), (-1, False))
                edges[p, x["value"]] = max(k, x["kind"]), r or x["refused"]
            if x["kind"] >= 0:
                seeds[x["value"]] = max(x["kind"], seeds.get(x["value"], -1))
    at = {}
    for (p, v), (k, bad) in edges.items():
        at.setdefault(p, []).append((v, k, bad))
    known = {v: (k, 1.0) for v, k in seeds.items()}
    while True:
        left = {}
        for p, held in at.items():
            for kind in range(4):
                mine = [known[v][1] for v, *_ in held if v in known and known[v][0] == kind]
                if len(mine) < support or len(held) < support:
                    continue
                mass = sum(mine)
                if p.startswith(pii.SHAPE):
                    w = mass / len(held)
                else:
                    unknown = [v for v, _, bad in held if v not in known and not bad]
                    alike = sum(("@" in v) == (kind == 0) for v in unknown)
                    against = sum(k not in (-1, kind) for _, k, _ in held) + sum(bad for *_, bad in held) + small[p] + len(unknown) - alike
                    w = mass / (mass + against + alike / (4 * mass))
                if w >= confident:
                    for v, k, bad in held:
                        if k == -1 and not bad and v not in known and ("@" in v) == (kind == 0):
                            left[v, kind] = left.get((v, kind), 1.0) * max(1e-9, 1 - w)
        fresh = {}
        for (v, kind), rest in sorted(left.items(), key=lambda x: (x[1], x[0][1])):
            if 1 - rest >= confident:
                fresh.setdefault(v, (kind, 1 - rest))
        if not fresh:
            return {v: k for v, (k, _) in known.items()}
        known |= fresh


def test_discovery_against_plain_rounds(spark):
    r = random.Random(4)
    made = {0: lambda: f"{r.choice('abc')}.{r.randint(1, 99)}@m{r.randint(1, 9)}.example.com", 1: lambda: ".".join(str(r.randint(1, 290)) for _ in range(4)), 2: lambda: f"{r.randint(10**15, 10**16 - 1)}", 3: lambda: f"+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}", 4: lambda: f"+1 | ({r.randint(100, 999)}) | 555-{r.randint(1000, 9999)}", 5: lambda: f"bob [at] m{r.randint(1, 9)} [dot] example [dot] com", 6: lambda: str(r.randint(10**6, 10**8))}
    words = ["mail", "address", "phone", "card", "number", "is", "the", "total"]
    texts = [" ".join(x for _ in range(r.randint(1, 4)) for x in (r.choice(words), r.choice(words), made[r.choice([0, 1, 2, 3, 3, 4, 5, 6])](), r.choice(words))) for _ in range(300)]
    want = brute_discover(texts, 0.6, 3)
    scanned = pii.scan(documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]).selectExpr("doc_id", "text", "xxhash64(text) AS text_key"))
    got = {x.value: x.new_kind for x in pii.discover(scanned, None, 0.6, 3).collect()}
    seeds = {x["value"] for t in texts for x in pii.scan_text(t)[1] if x["kind"] >= 0}
    assert got == want and len(set(want) - seeds) > 20


def test_shapes_discover_identifiers_behind_noise(spark):
    rows = [(i, f"w{i} +1 ({200 + i}) 555-{1000 + i} w{i + 1}", None, None, None) for i in range(16)]
    rows += [(100, "cell | +1 | (487) | 555-7209 | cell", None, None, None), (101, "deco$$$ +1&&& (487)### 555-7209$$$ deco", None, None, None), (103, "x +1 (826) 555-4081 190.137.223.204 y", None, None, None), (102, "years 2001 | 2002 | 2003 | 2004", None, None, None)]
    out = {x.doc_id: x for x in pii.find(documents(spark, rows)).collect()}
    assert out[100].spans == "phone:7:28" and out[101].spans == "phone:8:31" and out[102].spans == "" and out[103].spans == "phone:2:19,ip:20:35" and out[100].n_spans == 1 and out[100].n_phone == 0


def test_spans_within_others_are_not_shown_twice():
    assert pii.outermost([(0, 3, 5)], [(10, 3, 20), (12, 3, 15), (10, 3, 12), (30, 0, 31)]) == [(0, 3, 5), (10, 3, 20), (30, 0, 31)]


def test_contexts_find_most_of_what_is_unseen_at_every_share(spark):
    """A seeded context: of 400 phone numbers a share has the base form, the rest is written without a plus."""
    for share in (0.1, 0.3, 0.6, 0.75, 0.85, 0.95):
        r = random.Random(int(100 * share))
        rows = []
        for i in range(400):
            number = f"{r.randint(200, 999)} {r.randint(200, 999)} {r.randint(1000, 9999)}"
            rows.append((i, f"w{i} my phone number is {'+1 ' if i < 400 * share else ''}{number} thanks w{i}", None, None, None))
        rows += [(1000 + i, f"w{i} there were {i} of them on {r.randint(1, 28)} may {r.randint(1990, 2020)} for {r.randint(10**6, 10**8)} units", None, None, None) for i in range(100)]
        found = {x.doc_id: x.spans for x in pii.find(documents(spark, rows)).collect()}
        unseen = [i for i in range(400) if i >= 400 * share]
        assert sum(found[i].startswith("phone:") for i in unseen) >= 0.9 * len(unseen), share
        assert not any(found[1000 + i] for i in range(100)), share


def test_spelled_addresses_beside_plain_ones(spark):
    rows = [(i, f"w{i} contact me at u{i}{'@' if i % 2 else ' [at] '}m{i}{'.' if i % 2 else ' [dot] '}com w{i + 1}", None, None, None) for i in range(200)]
    found = pii.find(documents(spark, rows)).collect()
    assert all(x.spans.startswith("email:") for x in found)


def test_contexts_of_small_numbers_are_no_contexts(spark):
    rows = [(i, f"w{i} one of the +1 555 010 {1000 + i} x{i}", None, None, None) for i in range(20)]
    rows += [(100 + i, f"v{i} one of the {i + 2} y{i}", None, None, None) for i in range(30)]
    rows += [(200, "one of the 77665544 books", None, None, None)]
    assert {x.doc_id: x.spans for x in pii.find(documents(spark, rows)).collect()}[200] == ""


def test_stage_takes_any_column_name(spark):
    rows = documents(spark, [(1, "mail a.b@c.de now", "en", "s", 17), (None, None, None, None, None), (2, "none", "en", "s", 4)])
    for c in ("mark_id", "mark_key", "mark_spans", "mark_text", "row", "spans", "clean", "text_key", "value"):
        rows = rows.withColumn(c, F.lit("y"))
    out = pii.redact_documents(rows)
    assert out.columns == rows.columns and {x.doc_id: x.text for x in out.collect()} == {1: "mail [EMAIL] now", None: None, 2: "none"}
