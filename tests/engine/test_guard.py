"""The coverage guard against a plain reading of it, chunk by chunk."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql.types import StructType, _parse_datatype_string

from utterlake.functions import boundary
from utterlake.operators import guard, planner, stitch


def half_up(x):
    """To milliseconds as Spark rounds."""
    return float(Decimal(repr(x)).quantize(Decimal("0.001"), ROUND_HALF_UP))


def stats(silences, start, end):
    if end <= start:
        return 0.0, 0.0, 0.0
    at, covered, longest = start, 0.0, 0.0
    for s, e in sorted(silences):
        if min(e, end) > max(s, start):
            covered += min(e, end) - max(s, start)
            longest = max(longest, max(s, start) - at)
            at = max(at, min(e, end))
    heard = max(0.0, end - start - covered)
    return round(heard, 3), round(max(longest, end - at), 3), round(heard / (end - start), 3)


def script(rec, start, end, attempt):
    """Words of a second each; calls fail by a hash of what is asked, and some give text without words."""
    r = random.Random(f"{rec} {start:.3f} {end:.3f} {attempt}")
    kind = r.random()
    if rec % 7 == 0 or kind < (0.35 if attempt == 0 else 0.45):
        return "", []
    if kind < 0.5 and attempt > 1:
        end = min(end, start + r.choice([0.9, 1.5]))
    if kind > 0.7 and attempt == 0:
        end = start + (end - start) * r.random()
    words = [(chr(0x6000 + (rec * 37 + i) % 700), i - start, i + 1 - start) for i in range(math.ceil(start), math.floor(end))]
    if kind > 0.97:
        words.append(("。", end - start, end - start))
    return "".join(w for w, _, _ in words), [] if r.random() < 0.15 else words


def in_slices(silences, rec, start, end, attempt):
    total = end - start
    if total <= 30:
        return script(rec, start, end, attempt)
    cuts = planner.Cuts(total, cfg := planner.SplitConfig(target=15.0, search=5.0, max_chunk=20.0))
    places = []
    for s, e in sorted(silences):
        if e > start and s < end:
            places += cuts.silence(max(0.0, s - start), min(total, e - start))
    places += cuts.finish()
    text, last, words, lacks, before, how = "", "", (), False, 0.0, None
    for at, kind in places:
        drop = before if how else None
        a, b = half_up(max(0.0, before - cfg.overlap(how)) if how else 0.0), half_up(at)
        said, ws = script(rec, start + a, start + b, attempt)
        piece = stitch.settle(stitch.Piece(said, tuple(ws)), stitch.Chunk(a, b, drop, kind == "hard"), last)
        if piece.text:
            text, last = text + piece.text, piece.text
            ours, theirs = stitch.seam(stitch.Piece("", words), stitch.Piece("", piece.words))
            words, lacks = ours.words + theirs.words, lacks or not piece.words
        before, how = at, kind
    return text, [] if lacks else list(words)


def plain(rec, silences, start, end, kind):
    heard, longest, _ = stats(silences, start, end)
    if kind == "tail" and heard < 0.3 and longest < 0.2:
        return "", [], "SKIP_TAIL_LOW_VAD"
    text, words = script(rec, start, end, 0)
    status = "ok"
    if not text:
        status = "EMPTY_OK"
        if heard >= 2.0:
            text, words = script(rec, start, end, 1)
            status = "RESCUED_EMPTY_RETRY"
            if not text:
                text, words = in_slices(silences, rec, start, end, 2)
                status = "RESCUED_EMPTY_SPLIT" if text else "EMPTY_VAD_FALSE_POSITIVE"
    if text and words:
        last = start + max(e for _, _, e in words)
        tail, _, share = stats(silences, last, end)
        if tail >= 1.5 or tail >= 1.0 and share >= 0.5:
            again = max(start, last - 1.0)
            more, ws = script(rec, again, end, 3)
            names = "RESCUED_TAIL", "TAIL_RESCUE_NO_NEW_TEXT"
            if not more:
                more, ws = in_slices(silences, rec, again, end, 4)
                names = "RESCUED_TAIL_SPLIT", "TAIL_SPLIT_RESCUE_NO_NEW_TEXT"
            if not more:
                status = "TAIL_VAD_FALSE_POSITIVE"
            else:
                moved = [(w, round(s + (again - start), 3), round(e + (again - start), 3)) for w, s, e in ws]
                new, kept = boundary.rescue_dedup(moved, more, text, last - start)
                new = new if boundary.sound(new) else ""
                status = names[not new]
                text, words = text + new, [*words, *(kept if new else [])]
    if kind == "tail" and status in ("TAIL_VAD_FALSE_POSITIVE", "TAIL_RESCUE_NO_NEW_TEXT", "TAIL_SPLIT_RESCUE_NO_NEW_TEXT") and heard < 0.4 and len(text.strip()) <= 20:
        return "", [], "TAIL_HALLUCINATION_DROP"
    return text, words, status


@pytest.fixture(scope="module")
def recordings():
    r = random.Random(8)
    made = []
    for rec in range(60):
        at, silences = 0.0, []
        while at < 200:
            at += r.choice([0.5, 2.0, 9.0, 30.0]) * r.random() + 0.01
            silences.append((round(at, 3), round(at := at + r.choice([0.1, 0.5, 3.0, 25.0]) * r.random() + 0.01, 3)))
        made.append((rec, round(at - r.random() * 20, 2), silences))
    return made


def test_guard_against_chunk_by_chunk(spark, recordings):
    durations = spark.createDataFrame([(k, d) for k, d, _ in recordings], "rec long, duration double")
    silences = spark.createDataFrame([(k, s, e) for k, _, q in recordings for s, e in q], "rec long, start double, end double").repartition(3)

    def decode(rows):
        def run(batches):
            for b in batches:
                got = [script(k, s, e, a) for k, s, e, a in zip(b["rec"], b["start"], b["end"], b["attempt"], strict=True)]
                yield b.assign(text=[t for t, _ in got], words=[[{"word": w, "start": s, "end": e} for w, s, e in ws] for _, ws in got])

        return rows.mapInPandas(run, StructType([*rows.schema.fields, *_parse_datatype_string(f"text string, words {guard.WORDS}").fields]))

    got = guard.guard(planner.chunk_plans(durations, silences, "rec"), silences, "rec", decode).collect()
    held = {k: q for k, _, q in recordings}
    seen = set()
    for r in got:
        text, words, status = plain(r.rec, held[r.rec], r.audio_start, r.audio_end, r.kind)
        assert (r.text, r.status) == (text, status), (r.rec, r.chunk, r.passed)
        assert [(w.word, round(w.start, 6), round(w.end, 6)) for w in r.words] == [(w, round(s, 6), round(e, 6)) for w, s, e in words], (r.rec, r.chunk, r.passed)
        seen.add(status)
    assert len(got) > 200 and seen >= {"ok", "EMPTY_OK", "RESCUED_EMPTY_RETRY", "RESCUED_EMPTY_SPLIT", "EMPTY_VAD_FALSE_POSITIVE", "RESCUED_TAIL", "TAIL_RESCUE_NO_NEW_TEXT", "RESCUED_TAIL_SPLIT", "TAIL_VAD_FALSE_POSITIVE"}, seen


def test_every_decoder_call_is_made_once(spark, tmp_path):
    """Waves are written: what a wave decoded is not decoded again by a later one."""
    durations = spark.createDataFrame([(1, 50.0)], "rec long, duration double")
    silences = spark.createDataFrame([(1, 36.0, 37.0)], "rec long, start double, end double")
    path = str(tmp_path / "calls")

    def decode(rows):
        def run(batches):
            for b in batches:
                with open(path, "a") as f:
                    for x in b.itertuples():
                        f.write(f"{x.start} {x.end} {x.attempt}\n")
                yield b.assign(text=["" if a == 0 else "字" for a in b["attempt"]], words=[[] for _ in b["attempt"]])

        return rows.mapInPandas(run, StructType([*rows.schema.fields, *_parse_datatype_string(f"text string, words {guard.WORDS}").fields]))

    got = guard.guard(planner.chunk_plans(durations, silences, "rec"), silences, "rec", decode)
    assert {(r.chunk, r.status) for r in got.collect()} == {(0, "RESCUED_EMPTY_RETRY"), (1, "RESCUED_EMPTY_RETRY")} and got.count() == 2
    calls = open(path).read().split("\n")[:-1]
    assert len(calls) == len(set(calls)) == 4


def test_tails_without_speech(spark):
    durations = spark.createDataFrame([(1, 45.0), (2, 45.0), (3, 10.0)], "rec long, duration double")
    silences = spark.createDataFrame([(1, 34.0, 35.0), (1, 35.15, 45.0), (2, 34.0, 35.0), (2, 35.35, 45.0)], "rec long, start double, end double")
    asked = lambda rows: rows.selectExpr("*", "'嗯' AS text", f"cast(array(struct('嗯', 0.0D, 0.1D)) as {guard.WORDS}) AS words")
    got = {(r.rec, r.chunk): (r.status, r.text) for r in guard.guard(planner.chunk_plans(durations, silences, "rec"), silences, "rec", asked).collect()}
    assert got[1, 1] == ("SKIP_TAIL_LOW_VAD", "") and got[2, 1][0] == "ok" and got[1, 0] == ("RESCUED_TAIL", "嗯嗯")
    assert guard.guard(planner.chunk_plans(durations.limit(0), silences, "rec"), silences, "rec", asked).collect() == []
