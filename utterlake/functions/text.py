"""Text functions as column expressions: no Python per row, so filters and pruning pass through them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

# Sentence ends, quotes, joiners, and the punctuation that comparisons leave out.
SENTENCE_END = "。！？；!?"
QUOTES = "\"'“”‘’"
JOINERS = "，,、 "
PUNCTUATION = "。！？；!?，,、：:;；…—-\"'“”‘’（）()[]《》〈〉 \t"
TRAILING = " \t" + SENTENCE_END + JOINERS + QUOTES
#: Language codes and their names.
LANGUAGES = {
    "zh": "Chinese", "zh-cn": "Chinese", "zh-hans": "Chinese", "cn": "Chinese", "en": "English", "yue": "Cantonese",
    "zh-hk": "Cantonese", "zh-yue": "Cantonese", "ja": "Japanese", "ko": "Korean", "th": "Thai", "hi": "Hindi",
    "ar": "Arabic", "de": "German", "fr": "French", "es": "Spanish", "pt": "Portuguese", "id": "Indonesian",
    "it": "Italian", "ru": "Russian", "vi": "Vietnamese", "tr": "Turkish", "ms": "Malay", "nl": "Dutch",
    "sv": "Swedish", "da": "Danish", "fi": "Finnish", "pl": "Polish", "cs": "Czech", "el": "Greek", "ro": "Romanian",
    "hu": "Hungarian",
}
SPACE = r"(?U)\s"


def plain(text: Column) -> Column:
    """Without punctuation, spaces and tabs."""
    return F.translate(F.coalesce(text, F.lit("")), PUNCTUATION, "")


def has_content(text: Column) -> Column:
    """Whether anything besides white space and punctuation is in it."""
    return F.coalesce(text, F.lit("")).rlike(r"(?U)[^\s\p{P}]")


def strip(text: Column, space: str = SPACE) -> Column:
    """Without white space (Unicode, if not given) at either end."""
    return F.regexp_replace(text, rf"^(?:{space})+|(?:{space})+\z", "")


def strip_terminal(text: Column, ends: str = SENTENCE_END) -> Column:
    """Without sentence ends at the end; closing quotes stay."""
    return F.regexp_replace(text, rf"[{ends}]+([{QUOTES}]*)\z", "$1")


def strip_forced_stop(text: Column) -> Column:
    """Without the one full stop, and the quotes around it, that a forced cut leaves at the end."""
    bare = F.regexp_replace(text, rf"(?U)[\s{QUOTES}]+\z", "")
    return F.when(bare.endswith("。"), F.regexp_replace(F.left(bare, F.char_length(bare) - 1), rf"(?U)[\s{QUOTES}]+\z", "")).otherwise(bare)


def ideographs(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[一-鿿]"))


def ends_sentence(text: Column) -> Column:
    """Whether a text is done: a full stop or semicolon counts only after a short reply or a long last clause."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U)[\s{QUOTES}]+\z", "")
    body = F.regexp_replace(bare, rf"(?U)[。；;]+[\s{QUOTES}]*\z", "")
    last = F.element_at(F.split(body, f"[{SENTENCE_END}，,、：:]", -1), -1)
    return F.when(bare.rlike(r"[！？!?]\z"), True).when(bare.rlike(r"[。；;]\z"), (ideographs(bare) <= 4) | (ideographs(last) > 4)).otherwise(False)


def trim_fragment(text: Column) -> Column:
    """Without one or two characters that a cut leaves after a sentence end; a bare one must be an ideograph."""
    s = F.regexp_replace(text, r"(?U)\s+\z", "")
    marked = rf"(?s)^(.+[{SENTENCE_END}])\s*[^{SENTENCE_END}\s][^{SENTENCE_END}]?[{SENTENCE_END} \t]+\z"
    return F.regexp_replace(F.regexp_replace(s, rf"(?<=[{SENTENCE_END}])[一-鿿]\z", ""), marked, "$1")


def trim_dangling(text: Column) -> Column:
    """Without a character that was cut off after 的, 地 or 得, and its mark."""
    return F.regexp_replace(trim_fragment(text), rf"(?<=[的地得])[一-鿿][{SENTENCE_END}]\z", "")


def drop_sounds(text: Column, n: int) -> Column:
    """Without the last ``n`` characters that are no punctuation, and what stands around them."""
    silent = PUNCTUATION.replace("[", r"\[").replace("]", r"\]").replace("-", r"\-")
    return F.regexp_replace(text, rf"(?s)(?:[^{silent}][{silent}]*+){{0,{n}}}\z", "")


def carry_tail(text: Column, n: int = 5, space: str = SPACE) -> Column:
    """The last ``n`` characters if there is any ideograph, else the last ``n`` words; ``space`` parts words."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), rf"(?:{space})+"), lambda w: w != "")
    last = F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), n), " ")
    return F.when(text.rlike("[一-鿿]"), F.right(strip(text, space), F.lit(n))).otherwise(last)


def suffix_prefix(prev: Column, text: Column) -> Column:
    """Length of the longest end of ``prev`` that ``text`` starts with.

    Both are columns of plain text; only places where the last character fits are compared in full.
    """
    places = F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), (i + 1).alias("n")))
    ends = F.right(prev, F.lit(1))
    hits = F.filter(places, lambda x: (x["c"] == ends) & (x["n"] <= F.char_length(prev)) & (F.right(prev, x["n"]) == F.left(text, x["n"])))
    return F.coalesce(F.array_max(F.transform(hits, lambda x: x["n"])), F.lit(0))


def leftover_echo(prev: Column, text: Column) -> Column:
    """Whether a plain text of at most four characters only repeats the end of plain ``prev``."""
    n = F.char_length(text)
    return F.when(n == 0, True).when((n > 4) | (F.char_length(prev) == 0), False).otherwise(F.instr(F.right(prev, n + 2), text) > 0)


def preview(text: Column, width: int = 48) -> Column:
    """Length and, of a long text, both ends."""
    s = F.coalesce(text, F.lit(""))
    n = F.char_length(s)
    return F.concat(F.lit("n="), n.cast("string"), F.lit(" "), F.when(n <= 2 * width, s).otherwise(F.concat(F.left(s, F.lit(width)), F.lit("…"), F.right(s, F.lit(width)))))


def language_name(code: Column) -> Column:
    """Name of a language code; an unknown one with a capital letter first, an empty one and ``auto`` null."""
    raw = F.when(F.lower(F.trim(code)) != "auto", F.trim(code))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(known[F.lower(raw)], F.when(raw != "", F.concat(F.upper(F.left(raw, F.lit(1))), F.lower(F.substr(raw, F.lit(2))))))


#: Hesitation sounds, less words that begin with them; and one that is a filler only where no word ends.
SOUNDS = "呃+(?!逆)|嗯+(?![嗯哼])|哎+(?![哎呀哟])"
LONE_SOUND = "(?<![\u4e00-\u9fffA-Za-z0-9])啊+"


def clean_fillers(text: Column) -> Column:
    """Without hesitation sounds; a text that holds none is left as it is, punctuation included.

    Marks that a sound stood between become one: of two pauses a comma, of two stops a full stop, of a
    pause and a stop the stop.  Blanks between ideographs go, and so do marks left at either end.
    """
    cut = F.regexp_replace(F.regexp_replace(text, SOUNDS, ""), LONE_SOUND, "")
    pause, stop, halt = "，,、", "。；;", "。；;！？!?"
    tidy = F.regexp_replace(cut, rf"(?U)[{pause}](?:\s*[{pause}])+", "，")
    tidy = F.regexp_replace(tidy, rf"(?U)[{stop}](?:\s*[{stop}])+", "。")
    tidy = F.regexp_replace(tidy, rf"(?U)[{pause}]\s*(?=[{halt}])|(?<=[一-鿿])\s+(?=[一-鿿])", "")
    tidy = F.regexp_replace(strip(tidy), rf"^[{pause}{halt} ]+|[{pause} ]+\z", "")
    return F.when(cut == text, text).otherwise(tidy)


def short_runs(text: str, least: int, upto: int) -> set[tuple[int, int, int]]:
    """:func:`runs` of periods up to ``upto``: where a period is kept up for so long, one of the places so far apart shows it."""
    found: dict[tuple[int, int], int] = {}
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(text)
    for period in range(1, min(upto, n // least) + 1):
        step = max(1, (least - 1) * period)
        done = 0
        for at in (np.flatnonzero(code[: n - period : step] == code[period::step]) * step).tolist():
            if at < done:
                continue
            begin, end = at, at + period + 1
            while begin and text[begin - 1] == text[begin - 1 + period]:
                begin -= 1
            while end < n and text[end] == text[end - period]:
                end += 1
            done = end - period
            if end - begin >= least * period:
                found.setdefault((begin, end), period)  # a multiple of a shorter period spans the same
    return {(begin, end, period) for (begin, end), period in found.items()}


def runs(text: str, least: int) -> list[tuple[int, int, int]]:
    """(begin, end, period) of all stretches that equal themselves a shortest period further, ``least`` periods and longer.

    For each power of two a block at every multiple of it: in a stretch whose period is no longer, the block comes
    again one period on, and nowhere before.  All levels together look at n log n characters.  Short periods, whose
    blocks would be most of the work, are found apart (of two copies only, stretches of several periods overlap too far).
    """
    found, size = (short_runs(text, least, 8), 16) if least > 2 else (set(), 1)
    n = len(text)
    while size * least // 2 <= n:
        upto = 0
        for at in range(0, n - size + 1, size):
            if at + size <= upto:
                continue
            again = text.find(text[at : at + size], at + 1, at + 2 * size)
            if again < 0:
                continue
            period, begin, end = again - at, at, again + size
            while begin and text[begin - 1] == text[begin - 1 + period]:
                begin -= 1
            while end < n and text[end] == text[end - period]:
                end += 1
            if end - begin >= least * period:
                found.add((begin, end, period))
            upto = max(upto, end)
        size *= 2
    return sorted(found, key=lambda x: (x[0], x[2]))


def collapsed(text: str, least: int = 10) -> str:
    """A text with one copy of each unit that follows itself ``least`` times: from the left, the shortest unit first."""
    out, at, left = [], 0, runs(text, least)
    while left:
        # the stretch that still holds enough copies soonest
        left = [(max(b, at), e, p) for b, e, p in left if e - max(b, at) >= least * p]
        if not left:
            break
        begin, end, period = min(left, key=lambda x: (x[0], x[2]))
        out += [text[at:begin], text[begin : begin + period]]
        at = begin + (end - begin) // period * period
    return "".join([*out, text[at:]])


def collapse_repetitions(text: Column, least: int = 10) -> Column:
    """One copy of a unit of any length that follows itself at least ``least`` times."""

    @F.pandas_udf(StringType())
    def shorter(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: collapsed(t, least), na_action="ignore")

    return F.when(F.char_length(text) < least, text).otherwise(shorter(text))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of its table as one number.

    A bit of ``row`` is gone where the row above grows by one; a character of ``a`` moves the growth to the next
    place of ``b`` that holds it, which one addition does for the whole row.
    """
    places: dict[str, int] = {}
    for k, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << k
    row = whole = (1 << len(b)) - 1
    for c in a:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & whole
    return len(b) - row.bit_count()


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`common_length` of two columns."""
    return pd.Series([None if x is None or y is None else common_length(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def cost_of(a: Column, b: Column, common: Column) -> Column:
    """How unlike two words are spelled, from 0 to 1: one less the common subsequence's share of the longer."""
    return F.when(a == b, 0.0).otherwise(1 - common / F.greatest(F.char_length(a), F.char_length(b)))


def token_budget(seconds: Column) -> Column:
    """Most new tokens for so much audio: eight a second, from 32 to 512."""
    return F.least(F.lit(512), F.greatest(F.lit(32), F.floor(seconds * 8))).cast("int")
