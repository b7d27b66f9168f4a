"""Terms of a lexicon put right by the sound of the text.

A text becomes phonemes with character spans; each term's phonemes are aligned to it between word
edges with weighted costs; hits that are similar enough, do not stand near a blacklisted word and do
not overlap a better one are replaced.  Ideographs need a table from character to initial, final and
tone, which the caller gives; without one a character is its own phoneme.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np

# Groups of similar phonemes.
SIMILAR = [set(x.split()) for x in ("an ang", "en eng", "in ing", "ian iang", "uan uang", "z zh", "c ch", "s sh", "l n", "f h", "ai ei", "o uo", "e ie", "p t", "p b", "t d", "k g")]
WORDS = re.compile(r"[一-鿿]|[A-Za-z]+|[0-9]+")


class Phoneme(NamedTuple):
    value: str
    lang: str
    first: bool
    last: bool
    tone: bool
    start: int
    end: int


@dataclass(frozen=True)
class Term:
    target: str
    aliases: tuple[str, ...]
    black: tuple[str, ...]


def parse_lexicon(text: str) -> list[Term]:
    """Lines of ``target | alias | … ~~~ black | …``; blank lines and # comments are skipped, later lines win."""
    found: dict[str, Term] = {}
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("#"):
            continue
        names, _, black = line.partition("~~~")
        parts = [p.strip() for p in names.split("|") if p.strip()]
        if parts:
            found[parts[0]] = Term(parts[0], tuple(parts), tuple(b.strip() for b in black.split("|") if b.strip()))
    return list(found.values())


def phonemes(text: str, table: dict[str, tuple[str, str, str]] | None = None) -> list[Phoneme]:
    """Phonemes with character spans: ideographs by the table, ASCII letter by letter, a new word at each change."""
    out = []
    for m in WORDS.finditer(text):
        s = m[0]
        if "一" <= s <= "鿿":
            parts = [p for p in (table or {}).get(s, (s,)) if p]
            out += [Phoneme(p, "zh", k == 0, k == len(parts) - 1, p.isdigit(), m.start(), m.end()) for k, p in enumerate(parts)]
            continue
        edges = {0, *(i for i in range(1, len(s)) if s[i].isupper() and s[i - 1].islower())}
        for i, c in enumerate(s):
            out.append(Phoneme(c.lower(), "num" if c.isdigit() else "en", i in edges, i + 1 == len(s) or i + 1 in edges, False, m.start() + i, m.start() + i + 1))
    return out


def cost(want: Phoneme, have: Phoneme) -> float:
    """0 for the same, half for a tone of the term or a similar sound of its language, else 1."""
    if want.lang != have.lang:
        return 1.0
    if want.value == have.value:
        return 0.0
    return 0.5 if want.lang == "zh" and (want.tone or any({want.value, have.value} <= g for g in SIMILAR)) else 1.0


def alignments(term: list[Phoneme], text: list[Phoneme], least: float) -> list[tuple[float, int, int]]:
    """(score, first, end) of the best alignment to each word end, from a word start; score is 1 - distance / length."""
    n = len(term)
    if not n:
        return []
    limit = (1 - least) * n + 1e-9
    row = [(0.0, j) if j < len(text) and text[j].first else (float("inf"), j) for j in range(len(text) + 1)]
    for i, want in enumerate(term, 1):
        now = [(row[0][0] + 1 if row[0][0] < float("inf") else float("inf"), row[0][1])]
        for j, have in enumerate(text, 1):
            now.append(min((row[j - 1][0] + cost(want, have), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (now[j - 1][0] + 1, now[j - 1][1])))
        row = now
        if min(d for d, _ in row) > limit:
            return []
    return [(round(1 - d / n, 3), s, j) for j, (d, s) in enumerate(row) if j > s and d <= limit and text[j - 1].last]


class Lexicon:
    """Terms whose distances to a text are bounded from below, all aliases side by side.

    An alias is one machine word, a bit a phoneme; a column of all aliases' alignment tables is two such words each,
    and goes on by one phoneme of the text in a dozen operations on whole arrays.  A half cost counts nothing, and an
    alignment may start anywhere, so a bound never exceeds the distance and no hit above ``least`` is lost; only
    aliases whose bound stays within ``least`` at the end of a word are aligned, and only up to that end.
    """

    BITS = 64

    def __init__(self, terms: list[Term], table: dict[str, tuple[str, str, str]] | None = None, least: float = 0.85):
        self.table, self.least = table, least
        self.aliases = [(t, made) for t in terms for alias in t.aliases if (made := phonemes(alias, table))]
        self.short = np.array([k for k, (_, made) in enumerate(self.aliases) if len(made) <= self.BITS], np.int64)
        self.always = [k for k, (_, made) in enumerate(self.aliases) if len(made) > self.BITS]
        self.size = np.array([len(self.aliases[k][1]) for k in self.short], np.int64)
        self.where: dict[tuple[str, str], tuple[list[int], list[int]]] = {}  # of a phoneme: aliases and places
        self.tones: tuple[list[int], list[int]] = [], []
        for n, k in enumerate(self.short):
            for i, p in enumerate(self.aliases[k][1]):
                for held in (self.where.setdefault((p.lang, p.value), ([], [])), *([self.tones] if p.tone else [])):
                    held[0].append(n), held[1].append(i)
        self.masks: dict[tuple[str, str], np.ndarray] = {}

    def _mask(self, lang: str, value: str) -> np.ndarray:
        """Of each alias the places whose cost against a phoneme is less than one."""
        if (lang, value) not in self.masks:
            like = {value, *(x for g in SIMILAR if value in g for x in g)} if lang == "zh" else {value}
            out = np.zeros(len(self.short), np.uint64)
            for n, i in [*(self.where.get((lang, x), ([], [])) for x in like), *([self.tones] if lang == "zh" else [])]:
                np.bitwise_or.at(out, n, np.uint64(1) << np.array(i, np.uint64))
            self.masks[lang, value] = out
        return self.masks[lang, value]

    def ends_of(self, heard: list[list[Phoneme]], least: float | None = None) -> list[dict[int, list[int]]]:
        """Of each text, each alias that may be in it, by its number, and the word ends that it may reach.

        Texts go on side by side, a row each, the longest first, so that those that have ended are a rest.
        """
        limit = (1 - (self.least if least is None else least)) * self.size + 1e-9
        one, top = np.uint64(1), (self.size - 1).astype(np.uint64)
        found: list[dict[int, list[int]]] = [{} for _ in heard]
        block = max(1, 2**13 // max(1, len(self.short)))
        order = sorted(range(len(heard)), key=lambda t: -len(heard[t]))
        for at in range(0, len(order), block):
            held = order[at : at + block]
            kinds: dict[tuple[str, str], int] = {}
            steps, last = np.zeros((len(heard[held[0]]), len(held)), np.int64), np.zeros((len(heard[held[0]]), len(held)), bool)
            for r, t in enumerate(held):
                steps[: len(heard[t]), r] = [kinds.setdefault((p.lang, p.value), len(kinds)) for p in heard[t]]
                last[: len(heard[t]), r] = [p.last for p in heard[t]]
            masks = np.array([self._mask(*k) for k in kinds], np.uint64).reshape(len(kinds), len(self.short))
            lengths = np.array([len(heard[t]) for t in held])
            shape = (len(held), len(self.short))
            grows, falls, score = np.full(shape, ~np.uint64(0)), np.zeros(shape, np.uint64), np.tile(self.size, (len(held), 1))
            for j in range(len(steps)):
                n = int(np.count_nonzero(lengths > j))
                grows, falls, score = grows[:n], falls[:n], score[:n]
                same = masks[steps[j, :n]]
                down = same | falls
                across = (((same & grows) + grows) ^ grows) | same
                up, back = falls | ~(across | grows), grows & across
                score += ((up >> top) & one).astype(np.int64) - ((back >> top) & one).astype(np.int64)
                up, back = up << one, back << one
                grows, falls = back | ~(down | up), up & down
                rows = np.flatnonzero(last[j, :n])
                for r, k in zip(*(x.tolist() for x in np.nonzero(score[rows] <= limit)), strict=True):
                    found[held[rows[r]]].setdefault(int(self.short[k]), []).append(j + 1)
        return found

    def ends(self, heard: list[Phoneme], least: float | None = None) -> dict[int, list[int]]:
        """:meth:`ends_of` of one text."""
        return self.ends_of([heard], least)[0]

    def candidates(self, heard: list[Phoneme], least: float | None = None) -> list[int]:
        """Aliases that may be in a text, by their number."""
        return sorted([*self.ends(heard, least), *self.always])

    def places(self, k: int, ends: list[int]) -> Iterator[tuple[int, int]]:
        """Stretches of a text in which an alias can lie: before a word end, at most so long; those that meet are one."""
        n = len(self.aliases[k][1])
        reach = n + int((1 - self.least) * n + 1e-9)
        low = high = -1
        for j in ends:
            if low >= 0 and j - reach <= high:
                high = j
                continue
            if low >= 0:
                yield low, high
            low, high = max(0, j - reach), j
        if low >= 0:
            yield low, high

    def matches(self, text: str, window: int = 5, heard: list[Phoneme] | None = None, reached: dict[int, list[int]] | None = None) -> list[tuple[float, int, int, int, str]]:
        """(score, length, start, end, target) of every hit that stands near no blacklisted word; phonemes and word ends may be given."""
        heard = phonemes(text, self.table) if heard is None else heard
        words = [(m.start(), m.end(), m[0].lower()) for m in WORDS.finditer(text)]
        begins = [w[0] for w in words]
        hits = []
        ends = (self.ends(heard) if reached is None else reached) | {k: [len(heard)] for k in self.always}
        for k, at in sorted(ends.items()):
            term, alias = self.aliases[k]
            places = [(0, len(heard))] if k in self.always else self.places(k, at)
            found = {(score, low + i, low + j) for low, high in places for score, i, j in alignments(alias, heard[low:high], self.least)}
            for score, i, j in sorted(found):
                start, end = heard[i].start, heard[j - 1].end
                first, last = bisect_right(begins, start) - 1, bisect_left(begins, end)
                near = "".join(w[2] for w in words[max(0, first - window) : last + window])
                if not any(b.lower() in near for b in term.black):
                    hits.append((score, end - start, start, end, term.target))
        return hits

    def correct_all(self, texts: list[str], window: int = 5) -> list[tuple[str, list[tuple[int, int, str, float]]]]:
        """:meth:`correct` of texts that are searched side by side."""
        heard = [phonemes(t, self.table) for t in texts]
        return [self.correct(t, window, h, e) for t, h, e in zip(texts, heard, self.ends_of(heard), strict=True)]

    def correct(self, text: str, window: int = 5, heard: list[Phoneme] | None = None, reached: dict[int, list[int]] | None = None) -> tuple[str, list[tuple[int, int, str, float]]]:
        """The text with terms put right, and the replaced spans (start, end, target, score).

        The best and longest hits come first; one that overlaps a better one is left out.
        """
        taken: list[tuple[int, int, str, float]] = []  # in order of their places
        for score, _, start, end, target in sorted(self.matches(text, window, heard, reached), key=lambda h: (-h[0], -h[1])):
            k = bisect_left(taken, end, key=lambda t: t[0])
            if k == 0 or taken[k - 1][1] <= start:
                taken.insert(k, (start, end, target, score))
        changed = [t for t in taken if text[t[0] : t[1]] != t[2]]
        out, at = [], 0
        for start, end, target, _ in changed:
            out += [text[at:start], target]
            at = end
        return "".join([*out, text[at:]]), changed


def correct(text: str, terms: list[Term], table: dict[str, tuple[str, str, str]] | None = None, least: float = 0.85, window: int = 5) -> tuple[str, list[tuple[int, int, str, float]]]:
    """One text by a lexicon that is used once; see :class:`Lexicon`."""
    return Lexicon(terms, table, least).correct(text, window)
