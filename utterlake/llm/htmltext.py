"""Main text of web pages by equivalence-class template deduction.

Every page gives tokens: frames (its elements, by the path of names and classes and by the path of
places) and constant texts (blocks, by their path).  Tokens of one host with the same occurrence vector
over the host's distinct pages form an equivalence class.  Classes that enough pages hold make
the host's template, as far as they are valid: a frame's parent is a frame of the template, and a text
nests in a frame of its own class.  What is left of a frame after its class's own text is its slot.  The deepest frame that
occurs once a page and whose slot holds most of what varies, headings included, is the main slot; pages of
several layouts each find theirs.  Inside it, text of the template goes, and so do nested frames that
hold mostly links or that their class names mark.

A vector is never gathered: it is summed to one hash, so that a host with a third of all pages costs
one row per token and task.  A template holds at most 1 / ``support`` times the tokens of a mean page, so
one task deduces one host's.  Where a host has fewer than ``least`` distinct pages, or a page lacks the
main slot, the page's own article element and element and class names decide.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut

#: Elements whose content is no text, block elements, elements that hold blocks, boilerplate elements.
RAW = ("script", "style", "template", "textarea", "iframe", "svg")
BLOCKS = frozenset("html head body title article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption nav header footer aside form fieldset legend address details summary menu dialog hr center label option select button".split())
CONTAINERS = frozenset("html head body article main section div ul ol li dl dt dd table thead tbody tfoot tr td th blockquote figure nav header footer aside form fieldset details menu dialog select button".split())
BOILERPLATE = frozenset("head nav footer aside form menu dialog select button fieldset option label".split())
PLACED = frozenset("div section article main table header form aside".split())
#: An opening tag ends these open elements.
ENDS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
#: Words of class, id or role that mark boilerplate, and those that may stand beside them.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion sidebar sidebars cookie cookies consent notice notices alert alerts popup modal overlay comment comments disqus replies respond menu menus nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended recommendations newsletter subscribe signup login footer pagination pager widget widgets toolbar skip complementary contentinfo search masthead topbar gdpr paywall trending outbrain taboola feedback rating".split())
BESIDE = frozenset("section area list box wrap wrapper container inner outer block item items bar form reader readers user users site page top bottom left right col row links link buttons button main global group panel unit slot text".split())
SITE_HEADER = frozenset("header logo branding".split())
ARTICLE = frozenset("article main content post entry story".split())

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>=]|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?P<attrs>(?:[^>=]|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.S | re.I)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
DIGITS, PARTS = re.compile(r"\d+"), re.compile(r"[a-z]+")
NAMED, AT, TEXT = 1, 2, 3


def marked(names: list[str], words: frozenset[str]) -> bool:
    """Whether one of the class names consists of marking words, and of words that may stand beside them."""
    for name in names:
        parts = PARTS.findall(name.lower())
        if any(p in words for p in parts) and all(p in words or p in BESIDE for p in parts):
            return True
    return False


class Element(NamedTuple):
    parent: int  # place in the list of elements, -1 for none
    name: str
    named: int  # path of names and classes
    placed: int  # path of names and places
    classed: bool
    boiler: bool  # by its name, or in such an element
    marked: bool  # its own class words mark boilerplate
    article: bool  # an article element, or in one


class Block(NamedTuple):
    element: int
    tag: str
    text: str
    links: int  # code points of it that are link text


def _hash(parent: int, label: str) -> int:
    return xxhash.xxh64_intdigest(f"{parent:x}/{label}") - 2**63


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """Elements (parents first) and blocks of a page in order, in linear time.

    Unclosed elements end with their parent; a closing tag without an opening one is ignored.  A block
    element with class names that holds no blocks of its own is an element of its block.
    """
    elements: list[Element] = []
    blocks: list[Block] = []
    stack: list[int] = []
    open_: Counter = Counter()
    places: Counter = Counter()
    pieces: list[str] = []
    linked: list[str] = []
    tag, leaf, in_link = "", -1, False

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                links = len(" ".join(html.unescape("".join(linked)).split()))
                blocks.append(Block(leaf if leaf >= 0 else stack[-1] if stack else -1, tag, text, min(links, len(text))))
            pieces.clear(), linked.clear()

    def add(name: str, names: list[str]) -> int:
        up = stack[-1] if stack else -1
        above = elements[up] if up >= 0 else Element(-1, "", 0, 0, False, False, False, False)
        place = 0
        if name in PLACED:
            places[up, name] += 1
            place = places[up, name]
        boiler = above.boiler or name in BOILERPLATE or name == "header" and not above.article
        article = above.article or name in ("article", "main")
        own = name not in ("html", "body", "article", "main") and (marked(names, MARKS) or not above.article and marked(names, SITE_HEADER))
        label = name + "." + DIGITS.sub("#", " ".join(sorted(names))) if names else name
        elements.append(Element(up, name, _hash(above.named, label), _hash(above.placed, f"{name}{place or ''}"), bool(names), boiler, own, article))
        return len(elements) - 1

    for m in TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            pieces.append(text)
            if in_link:
                linked.append(text)
            continue
        if not m["tag"]:
            continue
        name = m["tag"].lower()
        if name not in BLOCKS:
            if name in ("br", "wbr", "img", "input"):
                pieces.append(" ")
            elif name == "a":
                in_link = not m["close"]
            continue
        flush()
        tag, leaf = "" if m["close"] else name, -1
        if m["close"]:
            if open_[name]:
                while True:
                    last = elements[stack.pop()].name
                    open_[last] -= 1
                    if last == name:
                        break
            continue
        while stack and elements[stack[-1]].name in ENDS.get(name, ()):
            open_[elements[stack.pop()].name] -= 1
        names = [x for a in ATTRIBUTE.finditer(m["attrs"]) for x in " ".join(g for g in a.groups()[1:] if g).split()] if m["attrs"] else []
        if name in CONTAINERS:
            stack.append(add(name, names))
            open_[name] += 1
        elif names or name in BOILERPLATE:
            leaf = add(name, names)
    flush()
    return elements, blocks


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


def text_token(elements: list[Element], block: Block) -> int:
    """A block's text with the names of the elements right around it."""
    e = elements[block.element] if block.element >= 0 else None
    above = elements[e.parent].name if e and e.parent >= 0 else ""
    return _hash(xxhash.xxh64_intdigest(block.text), f"{above}/{e.name if e else ''}/{block.tag}")


#: total and heads_total: what a page that holds the token has in all, of text outside links and of headings.
TOKENS = "host string, page long, kind int, token long, parent long, place long, n int, chars long, links long, heads long, total long, heads_total long, name string, classed boolean, marked boolean, boiler boolean"
_KINDS = dict(zip(("host", "page", "kind", "token", "parent", "place", "n", "chars", "links", "heads", "total", "heads_total", "name", "classed", "marked", "boiler"), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *(pa.int64() for _ in range(5)), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()), strict=True))


def page_tokens(source: str) -> list[tuple]:
    """Tokens of a page: kind, token, parent (of a text: its frame by class path), place (its frame by place), n, chars, links, heads, total, heads_total, name, classed, marked, boiler."""
    elements, blocks = parse(source)
    inside = [[0, 0, 0] for _ in elements]
    total = heads_total = 0
    texts: dict[int, list[int]] = {}
    for b in blocks:
        e = elements[b.element] if b.element >= 0 else None
        if e and e.boiler:
            continue
        heads = len(b.text) if b.tag in ("h1", "h2") else 0
        total, heads_total = total + len(b.text) - b.links, heads_total + heads
        if e:
            for i, x in enumerate((len(b.text), b.links, heads)):
                inside[b.element][i] += x
        got = texts.setdefault(text_token(elements, b), [e.named if e else 0, e.placed if e else 0, 0, 0, 0])
        for i, v in enumerate((1, len(b.text), heads)):
            got[2 + i] += v
    for k in range(len(elements) - 1, -1, -1):
        if (up := elements[k].parent) >= 0:
            for i in range(3):
                inside[up][i] += inside[k][i]
    frames: dict[tuple[int, int], list] = {}
    for e, x in zip(elements, inside, strict=True):
        above = elements[e.parent] if e.parent >= 0 else None
        for kind, token, parent in ((NAMED, e.named, above.named if above else 0), (AT, e.placed, above.placed if above else 0)):
            got = frames.setdefault((kind, token), [parent, 0, 0, 0, 0, e.name, e.classed, e.marked, e.boiler])
            for i, v in enumerate((1, *x)):
                got[1 + i] += v
    out = [(0, 0, 0, 0, 1, total, 0, heads_total, total, heads_total, "", False, False, False)]
    out += [(kind, token, g[0], 0, g[1], g[2], g[3], g[4], total, heads_total, *g[5:]) for (kind, token), g in frames.items()]
    out += [(TEXT, token, up, place, n, chars, 0, heads, total, heads_total, "", False, False, False) for token, (up, place, n, chars, heads) in texts.items()]
    return out


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            part = batch.slice(k, 200)
            rows = []
            for url, page in zip(part.column("url").to_pylist(), part.column("html"), strict=True):
                source = page.as_py()
                first = (host_of(url), xxhash.xxh64_intdigest(source) - 2**63)
                rows += [(*first, *t) for t in page_tokens(source)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)], names=list(_KINDS))


class Frame(NamedTuple):
    """A template frame of a host, summed over its distinct pages."""

    token: int
    parent: int
    vector: int
    pages: int
    most: int
    chars: int
    links: int
    heads: int
    total: int
    heads_total: int
    name: str
    classed: bool
    marked: bool
    boiler: bool


class Text(NamedTuple):
    """A text of a host that enough pages hold, with the frames right around it."""

    token: int
    vector: int
    chars: int
    heads: int
    parent: int
    place: int


def main_frames(tree: list[Frame], own: list[tuple[int, Text]], pages: int) -> tuple[list[Frame], dict[int, Frame]]:
    """The main slot's frames (one for each layout), and all frames by token.

    ``own`` gives the template's own texts with the frame around each.
    """
    at = {f.token: f for f in tree}
    inside: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    beside: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for t, x in own:
        beside[x.vector][0] += x.chars
        beside[x.vector][1] += x.heads
        while t in at:
            inside[t][0] += x.chars
            inside[t][1] += x.heads
            t = at[t].parent
    everywhere = {f.vector for f in tree if f.pages == pages}
    # a frame whose parent is no template frame nests in no slot
    nested = {0: True}
    for f in tree:
        chain, t = [], f.token
        while t not in nested and t in at:
            chain.append(t)
            t = at[t].parent
        nested.update(dict.fromkeys(chain, nested.get(t, False)))

    def fits(f: Frame) -> bool:
        """Whether most of what varies on the pages that hold a frame stands in it, headings included."""
        if not nested[f.token] or f.most != 1 or f.boiler or f.marked:
            return False
        chars, heads = f.chars - f.links - inside[f.token][0], f.heads - inside[f.token][1]
        around = [sum(beside[v][i] * (1 if v == f.vector else f.pages / pages) for v in everywhere | {f.vector}) for i in (0, 1)]
        return chars > 0 and 2 * chars >= f.total - around[0] and 10 * heads >= 9 * (f.heads_total - around[1])

    found = {f.token for f in tree if fits(f)}
    outer, inner = set(), set()
    for token in found:
        t = at[token].parent
        while t in at:
            if t in found:
                # whatever stands in an article element is part of it; else the deeper frame is the narrower slot
                inner.add(token) if at[t].name in ("article", "main") else outer.add(t)
            t = at[t].parent
    return [at[t] for t in sorted(found - inner) if t not in outer or at[t].name in ("article", "main")], at


def valid(text: Text, frames: dict[int, Frame], placed: dict[int, Frame]) -> bool:
    """Whether a text nests in a frame of its own class; a class that spreads over other slots says nothing of it."""
    for t, tree in ((text.parent, frames), (text.place, placed)):
        while t in tree:
            if tree[t].vector == text.vector:
                return True
            t = tree[t].parent
    return False


def deduce(frames: list[Frame], placed: list[Frame], texts: list[Text], pages: int, least_for_text: int) -> tuple[list[int], list[int], list[int]]:
    """A host's template from its frames by class path and by place, and its texts.

    Gives the main slot's frames, nested frames to leave out, and the template's own texts in the main slot.
    """
    trees = [{f.token: f for f in tree} for tree in (frames, placed)]
    own = [t for t in texts if valid(t, *trees)] if pages >= least_for_text else []
    # where what repeats is most of the pages, it is copies of one text and no template
    if 2 * sum(t.chars for t in own) > max((f.total for f in frames), default=0):
        own = []
    main, at = main_frames(frames, [(t.parent, t) for t in own], pages)
    narrow = [f for f in main if f.name not in ("html", "body")]
    if 2 * sum(f.pages for f in narrow) < pages:
        by_place, at_place = main_frames(placed, [(t.place, t) for t in own], pages)
        if by_place := [f for f in by_place if f.name not in ("html", "body")]:
            main, at = by_place, at_place
    tops = {f.token for f in main}
    inside: dict[int, bool] = {}
    for token in at:
        chain, t = [], token
        while t in at and t not in inside and t not in tops:
            chain.append(t)
            t = at[t].parent
        for x in chain:
            inside[x] = inside.get(t, t in tops)
    nested = [at[t] for t, deep in inside.items() if deep]
    drop = [f.token for f in nested if f.marked or f.classed and 2 * f.links >= f.chars > 0]
    slot_vectors = {f.vector for f in [*main, *nested]}
    return sorted(tops), sorted(drop), sorted(t.token for t in own if t.vector in slot_vectors)


def templates(pages: DataFrame, support: float = 0.05, least: int = 3, least_for_text: int = 10, most_broadcast: int = 1_000_000) -> DataFrame:
    """One row per host with a template: host, main, skip, texts (tokens).

    Tokens count if at least ``least`` distinct pages and a share of ``support`` of the host's hold them;
    text of the main slot counts on hosts of ``least_for_text`` distinct pages, as a few articles may share a passage.
    The page counts of hosts are broadcast if there are at most ``most_broadcast`` hosts.
    """
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    sums = ("chars", "links", "heads", "total", "heads_total")
    tokens = pages.mapInArrow(_tokens, TOKENS).groupBy("host", "kind", "token", "page").agg(F.max("n").alias("n"), *(F.max(c).alias(c) for c in (*sums, "parent", "place", "name", "classed", "marked", "boiler")))
    vectors = tokens.groupBy("host", "kind", "token").agg(F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count("*").alias("pages"), F.max("n").alias("most"), *(F.sum(c).alias(c) for c in sums), *(first(c) for c in ("parent", "place", "name", "classed", "marked", "boiler")))
    vectors = cut(vectors.filter(F.col("pages") >= least), "vectors")
    hosts = cut(vectors.filter("kind = 0").select("host", F.col("pages").alias("all_pages")), "hosts")
    held = vectors.filter("kind > 0").join(F.broadcast(hosts) if hosts.count() <= most_broadcast else hosts, "host").filter(F.col("pages") >= F.col("all_pages") * support)

    def one(found: pd.DataFrame) -> pd.DataFrame:
        # in order of their tokens, so that the result does not hang on how rows arrive
        found = found.sort_values(["kind", "token"])
        trees = [[Frame(*r) for r in found.loc[found.kind == kind, list(Frame._fields)].itertuples(index=False)] for kind in (NAMED, AT)]
        texts = [Text(*r) for r in found.loc[found.kind == TEXT, list(Text._fields)].itertuples(index=False)]
        main, skip, own = deduce(trees[0], trees[1], texts, int(found.all_pages.iloc[0]), least_for_text)
        return pd.DataFrame({"host": [found.host.iloc[0]], "main": [main], "skip": [skip], "texts": [own]})

    return held.groupBy("host").applyInPandas(one, "host string, main array<long>, skip array<long>, texts array<long>")


def slot_text(page: str, main: set[int], skip: set[int], texts: set[int]) -> str:
    """What the main slot of a page holds.

    Without a template, or without its slot on this page, the page's own article elements are taken, and
    without those its body; class words mark boilerplate only there.
    """
    elements, blocks = parse(page)
    slot = bytearray(len(elements))
    bad = bytearray(len(elements))
    for k, e in enumerate(elements):
        up = e.parent
        slot[k] = up >= 0 and slot[up] or e.named in main or e.placed in main
        bad[k] = up >= 0 and bad[up] or e.boiler or slot[k] and (e.named in skip or e.placed in skip)
    if any(slot):
        return "\n\n".join(b.text for b in blocks if b.element >= 0 and slot[b.element] and not bad[b.element] and b.tag != "title" and text_token(elements, b) not in texts)
    article = bytearray(len(elements))
    for k, e in enumerate(elements):
        up = e.parent
        bad[k] = up >= 0 and bad[up] or e.boiler or e.marked
        article[k] = up >= 0 and article[up] or not bad[k] and e.name in ("article", "main")
    chosen = [b for b in blocks if not (b.element >= 0 and bad[b.element]) and b.tag != "title"]
    own = [b for b in chosen if b.element >= 0 and article[b.element]]
    return "\n\n".join(b.text for b in own or chosen)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_bytes: int = 64_000_000, salts: int = 32) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    Null html is empty and gives an empty text; pages without a host in their url (null ones too) are
    taken as of one host.  Repeated pages count once in their host's template and are each returned.
    Other columns are not read; an empty table gives no rows.  Templates are broadcast if they take at
    most ``most_bytes``; else they are joined, each host's pages dealt over ``salts`` groups.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    found = cut(templates(source.select("url", "html")), "templates")
    size = found.agg(F.sum(F.length("host") + 64 + 8 * (F.size("main") + F.size("skip") + F.size("texts")))).first()[0] or 0
    rows = source.withColumn("host", host)
    if size <= most_bytes:
        rows = rows.join(F.broadcast(found), "host", "left")
    else:
        dealt = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(salts)).cast("int")).join(dealt, ["host", "salt"], "left")
    rows = rows.select("page_id", "url", "html", "main", "skip", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ((set(x.as_py() or ()) for x in batch.column(c)) for c in ("main", "skip", "texts"))
            text = [slot_text(h.as_py(), *template) for h, *template in zip(batch.column("html"), *sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
