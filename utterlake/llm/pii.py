"""Personal data: base patterns, and bootstrapped contextual extraction of what they miss.

One pass over the texts finds the base spans and the other identifier-like instances: tokens with five
digits or an at sign, digit groups (also with noise between them, as in table cells), account numbers
and spelled-out addresses.  Every instance has lexical patterns: the words beside it (contextual
rules) and the shape of its own spelling (spelling rules).  Base spans are the seeds of a graph whose
sides are patterns and values.  Spark scores that graph until it grows no more: a pattern by the known values
in it against those that speak against it, a value by the patterns it stands in.  Values that confident
patterns discover become further spans, wherever they stand.

What is not known yet does not speak against a context much, and the less the more of it is known, for contexts
are there to find the unknown.  Against it speak values that fail a base check, values of another kind, and short
numbers: a context that small numbers share is no context of identifiers.

All scans take time linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, per_worker, sized

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.  A run of digits is taken whole, which changes no match and needs no retries.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Identifier-like instances beyond them.
#: A token that holds a digit or an at sign; it is looked for at the start of tokens only, so the scan stays linear.
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
DIGIT, AT = re.compile(r"[0-9]"), re.compile(r"\w@\w")
#: Marks that carry no meaning inside an identifier: cell borders and decoration.
NOISE = r"|$&#%*!~^\\\[\]{}<>=_"
#: Digit groups of at most nine digits that spaces, dots, hyphens, brackets or noise join, and account numbers in groups of four.
GROUPS = re.compile(rf"(?<!\w)\+?\(?[A-Za-z]{{0,4}}[0-9]{{1,9}}+(?!\w)(?:[\x20.()\-{NOISE}]{{1,8}}[0-9]{{1,9}}+(?!\w))+")
ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?(?!\w)")
#: Spelled-out addresses: the mark for the at sign, and what follows it.
SPELLED_AT = re.compile(r"\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?|\x20(?:at|AT)\x20")
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?:\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]++)+")
SPELLED_DOT = re.compile(r"\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20")
WORD = re.compile(r"\w+")
NOISE_RUN, SPACES, GAP = re.compile(f"[{NOISE}]+"), re.compile(r"\s+"), re.compile(r"\s*([().-])\s*")
LETTERS, FIGURES = re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]+")
#: Code points of context that are looked at on either side.
CONTEXT = 60
SHAPE = "= "


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at sign: the longest run of allowed characters before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", m.end() if m else at + 1)


def _octet(part: str) -> bool:
    """Whether a part of an address is at most 255, however many zeros lead it."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _card(run: str) -> bool:
    digits = run.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order of start and then kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 14 and _card(m[0])]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def plain(value: str) -> str:
    """A value in lower case without noise, with one space at most between its parts and spelled-out marks as signs."""
    value = SPELLED_DOT.sub(".", SPELLED_AT.sub("@", value))
    value = SPACES.sub(" ", NOISE_RUN.sub(" ", value)).strip().lower()
    return value


def shape(value: str) -> str:
    """The spelling of a plain value: runs of letters become one a, digits keep their number unless it stands in an address."""
    if "@" in value:
        return FIGURES.sub("9", LETTERS.sub("a", value))
    return FIGURES.sub(lambda m: "9" * min(len(m[0]), 20), LETTERS.sub("a", GAP.sub(r"\1", value)))


def bare(value: str) -> bool:
    """Whether a plain value is digits alone that are no card: its spelling says nothing."""
    return bool(CARD.fullmatch(value)) and not _card(value)


def refused(value: str) -> bool:
    """Whether a plain value has the form of a base pattern, digits of a card included, and fails its check."""
    return bare(value) and 14 <= len(DIGIT.findall(value)) <= 19 or bool(IP.fullmatch(value)) and not all(map(_octet, value.split(".")))


def patterns(text: str, start: int, end: int, value: str) -> list[str]:
    """Lexical patterns of an instance: its contexts, and its shape if that tells anything."""
    return [*contexts(text, start, end), *([] if bare(value) or refused(value) else [SHAPE + shape(value)])]


def contexts(text: str, start: int, end: int) -> list[str]:
    """Two and three words before a place, two after it, and one on either side; numbers in them are alike.

    A single word is no context: every common one stands beside some identifier.
    """
    near = lambda part: [FIGURES.sub("0", w) for w in WORD.findall(part.lower())]
    before, after = near(text[max(0, start - CONTEXT) : start])[-3:], near(text[end : end + CONTEXT])[:2]
    found = [" ".join([*before[-k:], "_"]) for k in range(2, len(before) + 1)]
    if len(after) == 2:
        found.append(" ".join(["_", *after]))
    if before and after:
        found.append(f"{before[-1]} _ {after[0]}")
    return found


def _core(text: str, start: int, end: int) -> tuple[int, int]:
    """A token without the punctuation around it."""
    while start < end and not text[start].isalnum():
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Tokens with five or more digits, or an at sign between word characters."""
    for m in TOKEN.finditer(text):
        if len(DIGIT.findall(m[0])) >= 5 or "@" in m[0] and AT.search(m[0]):
            yield _core(text, m.start(), m.end())


def groups(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Identifiers of five or more digits that are written in groups, between the base spans."""
    yield from (m.span() for m in ACCOUNT.finditer(text))
    at = 0
    for s, e in [*taken, (len(text), len(text))]:
        if s > at:
            yield from (m.span() for m in GROUPS.finditer(text, at, s) if len(DIGIT.findall(m[0])) >= 5)
        at = max(at, e)


def spelled(text: str) -> Iterator[tuple[int, int]]:
    """Addresses whose signs are spelled out; a bare "at" needs a spelled dot."""
    for m in SPELLED_AT.finditer(text):
        start = m.start()
        while start > 0 and LOCAL.match(text, start - 1):
            start -= 1
        host = SPELLED_DOMAIN.match(text, m.end()) if start < m.start() else None
        if host and (m[0].strip().lower() != "at" or SPELLED_DOT.search(host[0])):
            yield start, host.end()


#: Numbers of up to four digits, which identify nobody.
SMALL = re.compile(r"(?<![\w.+-])[0-9]{1,4}(?![\w]|[.-][0-9])")


def background(text: str, found: list[dict]) -> list[str]:
    """Contexts of the small numbers of a text that stand in no instance, each once."""
    out, k, reach = set(), 0, 0
    spans = sorted((x["start"], x["end"]) for x in found)
    for m in SMALL.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][1])
            k += 1
        if reach <= m.start():
            out.update(contexts(text, *m.span()))
    return sorted(out)


SCAN = "doc_id long, text_key long, small array<string>, base string, n_email long, n_ip long, n_card long, n_phone long, found array<struct<kind:int,start:int,end:int,value:string,refused:boolean,patterns:array<string>>>"
FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("refused", pa.bool_()), ("patterns", pa.list_(pa.string()))]))


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """Base spans, and instances: those spans and the other identifier-like ones (kind -1), which are clear of them."""
    spans = base_spans(text)
    found = [(s, e, k) for s, k, e in spans]
    if DIGIT.search(text) or "@" in text or SPELLED_AT.search(text):
        taken = sorted((s, e) for s, _, e in spans)
        more = sorted({*tokens(text), *groups(text, taken), *spelled(text)})
        k, reach = 0, 0
        for s, e in more:
            while k < len(taken) and taken[k][0] < e:
                reach = max(reach, taken[k][1])
                k += 1
            # spans that start before e reach no further than here
            if s < e and reach <= s:
                found.append((s, e, -1))
    out = []
    for s, e, k in found:
        value = plain(text[s:e])
        out.append({"kind": k, "start": s, "end": e, "value": value, "refused": k < 0 and refused(value), "patterns": patterns(text, s, e, value)})
    return spans, out


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text, text_key): base spans and instances with their patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_worker(("pii",), bool)
        for batch in batches:
            base, counts, found, small = [], [[], [], [], []], [], []
            for t in batch.column(1):
                spans, more = scan_text(t.as_py())
                base.append(shown(spans)), found.append(more), small.append(background(t.as_py(), more))
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(small, pa.list_(pa.string())), pa.array(base, pa.string()), *(pa.array(c, pa.int64()) for c in counts), pa.array(found, FOUND)], names=["doc_id", "text_key", "small", "base", "n_email", "n_ip", "n_card", "n_phone", "found"])

    return docs.mapInArrow(run, SCAN)


def discover(scanned: DataFrame, rounds: int | None, confident: float, support: int, most_broadcast: int = 1_000_000, few_edges: int = 200_000) -> DataFrame:
    """Values that the pattern graph makes known beyond the seeds: value, new_kind.

    Edges are (pattern, value), once each however often they occur; small numbers count once a text.  A pattern
    counts for a kind if at least ``support`` known values of it stand there.  A context scores
    ``known / (known + against + open / (4 * known))``: known values by their scores; against it seeds of other
    kinds, values that fail a base check, small numbers, and open ones of another form (addresses among numbers, or
    numbers among addresses).  A shape scores its share of known values, as open ones say that it is common.  An open
    value of the right form scores 1 - product of (1 - score) over the patterns that reach ``confident``, and is
    known from then on if its own score does.  Known values only grow; the rounds end when none is new, or after
    ``rounds``.  Only patterns with ``support`` values take part.  Those that count are broadcast if at most
    ``most_broadcast`` of them (of some 40 bytes) are found; else both sides are shuffled.
    No other side of a join has more rows than there are edges: up to ``few_edges`` Spark chooses, beyond them both
    sides are shuffled.
    """
    found = scanned.select(F.explode("found").alias("x")).select("x.kind", "x.value", "x.refused", F.explode("x.patterns").alias("pattern"))
    every = cut(found.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.max("refused").alias("refused")), "every")
    side = (lambda df: df) if every.count() <= few_edges else sized
    seeds = cut(every.filter("kind >= 0").groupBy("value").agg(F.max("kind").alias("kind")).withColumn("score", F.lit(1.0)), "seeds")
    common = every.groupBy("pattern").agg(F.count("*").alias("n"), F.max("kind").alias("most"), F.min("kind").alias("least")).filter((F.col("n") >= support) & (F.col("least") < 0))
    edges = cut(every.join(side(common.select("pattern")), "pattern", "left_semi").withColumn("address", F.col("value").contains("@")), "edges")
    small = scanned.select("text_key", F.explode("small").alias("pattern")).join(side(edges.select("pattern").distinct()), "pattern", "left_semi").distinct().groupBy("pattern").agg(F.count("*").alias("small"))
    number = lambda c: F.sum(c.cast("long"))
    kinds = [F.sum((F.col("kind") == k).cast("long")).alias(f"seeds{k}") for k in range(len(KINDS))]
    sides = cut(edges.groupBy("pattern").agg(F.count("*").alias("n"), number(F.col("address")).alias("addresses"), number(F.col("refused")).alias("refused"), *kinds).join(side(small), "pattern", "left").fillna(0, ["small"]), "sides")
    open_ = edges.filter((F.col("kind") == -1) & ~F.col("refused"))
    known = seeds
    for _ in count() if rounds is None else range(rounds):
        scored = edges.select("pattern", "value", "address").join(side(known), "value").groupBy("pattern", F.col("kind").alias("new_kind")).agg(F.sum("score").alias("mass"), F.count("*").alias("held"), number(F.col("address")).alias("held_addresses"))
        whole = scored.groupBy("pattern").agg(F.sum("held").alias("all_held"), F.sum("held_addresses").alias("all_addresses"))
        at = scored.filter(F.col("held") >= support).join(side(whole), "pattern").join(side(sides), "pattern")
        addresses = F.col("addresses") - F.col("all_addresses")
        numbers = F.col("n") - F.col("addresses") - F.col("refused") - (F.col("all_held") - F.col("all_addresses"))
        email, others = F.col("new_kind") == 0, sum((F.when(F.col("new_kind") == k, 0).otherwise(F.col(f"seeds{k}")) for k in range(len(KINDS))), F.lit(0))
        alike, unlike = F.when(email, addresses).otherwise(numbers), F.when(email, numbers).otherwise(addresses)
        against = others + F.col("refused") + F.col("small") + unlike + alike / (4 * F.col("mass"))
        weight = F.when(F.col("pattern").startswith(SHAPE), F.col("mass") / F.col("n")).otherwise(F.col("mass") / (F.col("mass") + against))
        good = cut(at.select("pattern", "new_kind", weight.alias("weight")).filter(F.col("weight") >= confident), "good")
        new = open_.join(sized(good, good.count() <= most_broadcast), "pattern").filter(F.col("address") == (F.col("new_kind") == 0))
        new = new.groupBy("value", "new_kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("weight")))))).alias("score"))
        best = new.groupBy("value").agg(F.max(F.struct("score", (-F.col("new_kind")).alias("first"))).alias("b")).select("value", (-F.col("b.first")).alias("kind"), F.col("b.score").alias("score"))
        fresh = cut(best.filter(F.col("score") >= confident).join(side(known), "value", "left_anti"), "fresh")
        if fresh.isEmpty():
            break
        known = cut(known.unionByName(fresh), "known")
    # a seed's value is known wherever it stands, also where noise hides it from the base pattern
    return known.select("value", F.col("kind").alias("new_kind"))


def outermost(own: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Own spans, and of the others (start, kind, end) those that lie in no other, by start and then kind."""
    out, reach = list(own), -1
    for s, k, e in sorted(more, key=lambda x: (x[0], -x[2], x[1])):
        if e > reach:
            out.append((s, k, e))
            reach = e
    return sorted(out)


def _spans(source: DataFrame, rounds: int | None, confident: float, support: int) -> DataFrame:
    """Of each row of (doc_id, text): doc_id, text_key, base counts, base and all spans."""
    scanned = cut(scan(source.select("doc_id", "text", F.xxhash64("text").alias("text_key"))).withColumn("row", F.monotonically_increasing_id()), "scanned")
    new = discover(scanned, rounds, confident, support)
    open_ = scanned.select("row", F.explode(F.filter("found", lambda x: x["kind"] == -1)).alias("x")).select("row", "x.start", "x.end", "x.value")
    more = open_.join(sized(new, new.count() <= 200_000), "value").groupBy("row").agg(F.collect_list(F.struct("start", F.col("new_kind").alias("kind"), "end")).alias("more"))
    counts = ["n_email", "n_ip", "n_card", "n_phone"]
    own = F.transform(F.filter("found", lambda x: x["kind"] >= 0), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    rows = scanned.select("row", "doc_id", "text_key", "base", *counts, own.alias("own")).join(sized(more), "row", "left")

    @F.pandas_udf("string")
    def every(base: pd.Series, found: pd.Series) -> pd.Series:
        triples = lambda xs: [] if xs is None else [(x["start"], x["kind"], x["end"]) for x in xs]
        return pd.Series([shown(outermost(triples(b), triples(f))) for b, f in zip(base, found, strict=True)], dtype=object)

    # rows without a discovery need no worker
    plain_rows = rows.filter("more is null").select("doc_id", "text_key", *counts, "base", F.col("base").alias("spans"))
    return plain_rows.unionByName(rows.filter("more is not null").select("doc_id", "text_key", *counts, "base", every("own", "more").alias("spans")))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None, confident: float = 0.8, support: int = 3) -> DataFrame:
    """Personal data of every whole text.

    Returns doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and
    discovered spans as kind:start:end by start, then kind), n_spans.  Null and empty texts have none.
    Repeated rows are each returned; a null id is a row like any other.  Other columns are not read;
    an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = _spans(source, rounds, confident, support)
    n = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", n.alias("n_spans"))


def redact_documents(docs: DataFrame, *, rounds: int | None = None, confident: float = 0.8, support: int = 3) -> DataFrame:
    """Rows of ``docs`` with every span of personal data replaced by its kind, and n_chars to match.

    Only rows with spans change; null texts stay null and other columns stay as they are.
    """
    # a row travels as one column, so that no name of its own meets one made here
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    text = F.coalesce("row.text", F.lit(""))
    named = rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), text.alias("text"), "row")
    spans = _spans(named.select("doc_id", "text"), rounds, confident, support)
    marks = spans.filter("spans <> ''").select(F.col("doc_id").alias("mark_id"), F.col("text_key").alias("mark_key"), "spans").dropDuplicates(["mark_id", "mark_key"])
    joined = named.join(marks, F.col("doc_id").eqNullSafe(F.col("mark_id")) & (F.xxhash64("text") == F.col("mark_key")), "left")

    @F.pandas_udf("string")
    def clean(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else redact(t, s) for t, s in zip(texts, found, strict=True)])

    has = F.col("spans").isNotNull()
    out = joined.withColumn("clean", clean(F.when(has, F.col("text")), "spans"))
    new = {"text": F.when(has, F.col("clean")).otherwise(F.col("row.text")), "n_chars": F.when(has, F.char_length("clean").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def redact(text: str, spans: str) -> str:
    """A text with each span replaced by its kind in square brackets; spans that overlap become one."""
    marks = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x))
    out, at = [], 0
    for s, e, k in marks:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])

