"""Repetitions with short periods against a plain search."""

import random

from utterlake.functions import text as T


def plain(text, least, upto):
    found = {}
    for p in range(1, upto + 1):
        at = 0
        while at + p < len(text):
            end = at + p
            while end < len(text) and text[end] == text[end - p]:
                end += 1
            if end - at >= least * p:
                found.setdefault((at, end), p)
            at = max(at + 1, end - p + 1)
    return {(b, e, p) for (b, e), p in found.items()}


def test_short_periods():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join("".join(rng.choices("ab😀", k=rng.randint(1, 9))) * rng.choice((1, 9, 10, 13)) for _ in range(3))
        for least in (3, 10):
            assert T.short_runs(text, least, 8) == plain(text, least, 8)
