"""Spoken Chinese numbers to digits: integers, decimals, percent, fractions, ratios, ranges, dates, clocks."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits, powers, written units, set phrases, words that tell the time of day.
DIGIT = {"零": 0, "幺": 1, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
POWER = {"十": 10, "百": 100, "千": 1000}
GROUP = {"万": 10_000, "亿": 100_000_000}
UNITS = {"千米每小时": "km/h", "千克": "kg", "克": "g", "千米": "千米", "米": "米"}
PLAIN_UNITS = "个只分秒年月日天时钟人层楼倍块次两斤"
IDIOMS = (
    "正经八百 五零二落 五零四散 五十步笑百步 乌七八糟 污七八糟 四百四病 思绪万千 十有八九 十之八九 三十而立 三十六策 三十六计 三十六行 "
    "三五成群 三百六十行 三六九等 七老八十 七零八落 七零八碎 七七八八 乱七八遭 乱七八糟 略知一二 零零星星 零七八碎 二三其德 二三其意 "
    "无银三百两 八九不离十 年三十 烂七八糟 一点一滴 路易十六 九三学社 五四运动 入木三分 九九八十一 三七二十一 十二五 十三五 十四五 "
    "十五五 十六五 十七五 十八五"
).split()
DAYTIME = ("上午", "下午", "晚上", "早上", "凌晨", "傍晚", "中午")

D, N = "零幺一二两三四五六七八九", "零幺一二两三四五六七八九十百千万亿"
A = f"(?:[{N}]+|[0-9]+)"
CANDIDATE = re.compile(
    rf"(?P<sign>[正负])?(?:(?P<percent>[百千])分之(?P<of>[{N}点]+)"
    rf"|(?P<low>[{N}]+)分之(?P<high>[{N}]+)"
    rf"|(?P<date>(?:{A}年)?(?:{A}月)?(?:{A}[日号])?)(?P<hour>{A})点(?P<minute>{A})(?P<mark>分(?:(?P<second>{A})秒)?)?(?![{N}0-9])"
    rf"|(?P<day>(?:{A}年)?(?:{A}月)(?:{A}[日号])?|{A}年(?:{A}[日号])?|{A}[日号])"
    rf"|(?P<left>[{N}]+)比(?P<right>[{N}]+)"
    rf"|(?P<number>[{N}几]+(?:点[{D}]+)?(?:万亿|[万亿])?))"
)


def integer(s: str) -> int | None:
    """Value of an integer; a last digit right after a power stands for the next lower place."""
    if s.isascii():
        return int(s)
    if all(c in DIGIT for c in s):
        return int("".join(str(DIGIT[c]) for c in s))
    total = section = 0
    digit, last = None, 0
    for i, c in enumerate(s):
        if c in DIGIT:
            if digit:
                return None
            digit = DIGIT[c]
            last = 0 if digit == 0 else last
        elif c in POWER:
            section += POWER[c] * (digit if digit else 1 if digit is None else 0)
            digit, last = None, POWER[c]
        else:
            section += digit or 0
            total = (total + section) * GROUP[c] if total < GROUP[c] else total + section * GROUP[c]
            section, digit, last = 0, None, GROUP[c]
            if total == 0 and i == 0:
                total = GROUP[c]
    return total + section + (digit or 0) * (last // 10 if last >= 100 else 1)


def digits(s: str) -> str:
    """Each character as a digit."""
    return "".join(str(DIGIT[c]) if c in DIGIT else c for c in s)


def spoken_range(s: str) -> str | None:
    """Two neighbouring digits (or three and five) that stand for a range: their two values."""
    m = re.fullmatch(rf"(?P<base>[{N}]*[十百千万])?(?P<a>[一二两三四五六七八九])(?P<b>[一二三四五六七八九])(?P<power>[十百千])?(?P<group>万亿|[万亿])?", s)
    if not m:
        return None
    a, b = DIGIT[m["a"]], DIGIT[m["b"]]
    if b - a != 1 and (a, b) != (3, 5):
        return None
    base, group = m["base"], m["group"] or ""
    step = POWER.get(m["power"] or "", 1)
    if not base:
        if m["power"] == "千" and group:
            return f"{a}~{b}千{group}"
        return f"{a * step}~{b * step}{group}"
    value = integer(base)
    if value is None or (m["power"] and m["power"] != "十"):
        return None
    step = 10 if m["power"] else (POWER | GROUP)[base[-1]] // 10
    return f"{value + a * step}~{value + b * step}{group}"


def number(s: str) -> str | None:
    """Digits of a number; a last 万, 亿 or 万亿 stays as it is written."""
    if not s:
        return None
    for unit in ("万亿", "万", "亿"):
        if s.endswith(unit) and len(s) > len(unit):
            head = number(s[: -len(unit)])
            return head and head + unit
    if "点" in s:
        whole, part = s.split("点", 1)
        value = digits(whole) if all(c in DIGIT for c in whole) else integer(whole)
        return None if value is None or not part or not all(c in DIGIT for c in part) else f"{value}.{digits(part)}"
    if all(c in DIGIT for c in s):
        return digits(s)
    value = integer(s)
    return None if value is None else str(value)


def clock(m: re.Match, forced: bool) -> str | None:
    """Hours and minutes; without a word that tells the time, spoken minutes without a ten are a decimal's digits."""
    hour, minute = integer(m["hour"]), m["minute"]
    sure = forced or bool(m["mark"]) or bool(m["date"])
    value = integer(minute.lstrip("零")) if minute.strip("零") else 0
    if hour is None or value is None or hour > 24 or value > 59:
        return None
    if not sure and "十" not in minute and (not minute.isascii() or minute[0] == "0" or value < 10):
        return None
    out = f"{hour}:{value:02}"
    if m["second"]:
        second = integer(m["second"].lstrip("零") or "零")
        out += f":{second:02}"
    return out


def date(s: str) -> str:
    """Year digit by digit if it is spoken so, month and day as numbers."""
    return re.sub(rf"({A})([年月日号])", lambda m: (digits(m[1]) if m[2] == "年" and all(c in DIGIT for c in m[1]) else str(integer(m[1]))) + m[2], s)


@lru_cache(1)
def _idioms(text: str) -> list[str]:
    """Idioms that a text holds; asked for again by each of its numbers."""
    return [idiom for idiom in IDIOMS if idiom in text]


def _replace(m: re.Match) -> str:
    text, whole = m.string, m[0]
    start, end = m.span()
    sign = {"负": "-", "正": "+", None: ""}[m["sign"]]
    if "〇" in (text[start - 1 : start], text[end : end + 1]):  # a written zero: half of such a run would be wrong
        return whole
    for idiom in _idioms(text):
        at = text.find(idiom)
        if at >= 0 and max(start - 2, 0) <= at < end and len(whole) <= len(idiom):
            return whole
    if "几" in whole:
        return whole
    if m["percent"]:
        value = number(m["of"])
        return whole if value is None else sign + value + ("%" if m["percent"] == "百" else "‰")
    if m["low"]:
        low, high = number(m["low"]), number(m["high"])
        return whole if low is None or high is None else f"{sign}{high}/{low}"
    if m["left"]:
        left, right = number(m["left"]), number(m["right"])
        return whole if left is None or right is None else f"{sign}{left}:{right}"
    if m["day"]:
        return date(whole)
    if m["hour"]:
        before = text[max(0, start - 4) : start]
        if found := clock(m, any(before.endswith(w) for w in DAYTIME)):
            return date(m["date"]) + sign + found
        tail = (m["mark"] or "")
        s = f"{m['hour']}点{m['minute']}"
        follow = re.match("万亿|[万亿]", text[end:])
        value = None if m["date"] or tail else number(s)
        return whole if value is None or follow and not value else sign + value
    s = m["number"]
    after = text[end:]
    head = text[start - 1 : start]
    # the tail of a longer numeral is no term of its own; 万 and one digit alone is a rate
    if re.fullmatch("[百千万][一二三四五六七八九]", s) or all(c in "十百千万亿" for c in s) and len(s) > 1:
        return whole
    if s == "十" and after[:1] == "分" and after[1:2] not in ("钟", "之") and "一" <= after[1:2] <= "鿿":
        return whole
    unit = next((u for u in UNITS if after.startswith(u)), "") or (after[:1] if after[:1] and (after[0] in PLAIN_UNITS or after[0].isascii() and after[0].isalpha()) else "")
    if len(s) == 1 and not sign and not (unit or (head.isascii() and head.isalpha())):
        return whole
    if s in ("零", "百", "千", "万", "亿"):
        return whole
    if len(s) > 1 and s[-1] == "千" and after[:1] in ("克", "米"):
        s, unit = s[:-1], "千"
        value = number(s)
        return whole if value is None else sign + value + unit
    value = spoken_range(s) or number(s)
    return whole if value is None else sign + value


def to_digits(text: str | None) -> str | None:
    """A text with its spoken numbers in digits."""
    if not text:
        return text
    out = CANDIDATE.sub(_replace, text)
    for unit, short in UNITS.items():
        if unit != short:
            out = re.sub(rf"(?<=[0-9]){unit}", short, out)
    return out


HAS = re.compile(f"[{N}]|[0-9]点")


@lru_cache(2**16)
def _sure(text: str) -> str:
    try:
        return to_digits(text)
    except ValueError:
        return text


def sure(text: str, longest: int = 40) -> str:
    """:func:`to_digits`, or the text itself if its numerals cannot be read (one of thousands of digits); short phrases come again and are kept."""
    return _sure(text) if len(text) <= longest else _sure.__wrapped__(text)


def normalise(text: Column, once: bool = False) -> Column:
    """:func:`to_digits` on a column; texts without a numeral do not go through Python's work.

    A text whose numerals cannot be read stays as it is.  With ``once`` Python looks for numerals too, so
    that an expression that is costly to make is made once.
    """

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sure(t) if not once or HAS.search(t) else t, na_action="ignore")

    if once:
        return convert(text)
    has = text.rlike(HAS.pattern)
    return F.when(has, convert(F.when(has, text))).otherwise(text)


def spell_digits(digits: Column) -> Column:
    """Digits one by one."""
    return F.translate(digits, "0123456789", "零一二三四五六七八九")


def spell(n: Column) -> Column:
    """A whole number from 0 to 999 999 999 999 as it is spoken."""
    text = F.regexp_replace(spell_digits(F.lpad(n.cast("string"), 12, "0")), "^(.)(.)(.)(.)(.)(.)(.)(.)(.)(.)(.)(.)$", "$1千$2百$3十$4亿$5千$6百$7十$8万$9千$10百$11十$12")
    for pattern, to in (("零[千百十]", "零"), ("零+", "零"), ("零([亿万])", "$1零"), ("亿零*万", "亿零"), ("零+", "零"), ("零$|^[零万亿]+", "")):
        text = F.regexp_replace(text, pattern, to)
    return F.when(n == 0, "零").when(n < 20, F.regexp_replace(text, "^一十", "十")).otherwise(text)
