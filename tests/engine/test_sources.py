import io
import math
import wave

import numpy as np

from utterlake.operators.planner import Cuts
from utterlake.sources import audio, logs


def wav(x, rate=16_000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes((np.repeat(x, channels) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_scan_of_wav_files(spark, tmp_path):
    tone = lambda s, rate: 0.5 * np.sin(2 * math.pi * 440 * np.arange(int(s * rate)) / rate)
    x = np.concatenate([tone(1, 16_000), np.zeros(16_000), tone(1, 16_000), np.zeros(8_000)])
    (tmp_path / "a.wav").write_bytes(wav(x, channels=2))
    (tmp_path / "b.wav").write_bytes(wav(tone(2, 8_000), 8_000))
    (tmp_path / "c.wav").write_bytes(b"no wav")
    frames = audio.scan_wavs(spark, str(tmp_path)).cache()
    got = sorted((r.source_id[-5:], r.start, r.end) for r in audio.silences(frames).collect())
    assert [g[0] for g in got] == ["a.wav", "a.wav"]
    assert abs(got[0][1] - 1) < 0.04 and abs(got[0][2] - 2) < 0.04 and got[1][2] == 3.5
    cuts = Cuts(3.5)
    assert [c for g in got for c in cuts.silence(*g[1:])] + list(cuts.finish()) == [(3.5, "tail")]
    loud = audio.resample(tone(1, 8_000), 8_000)
    assert len(loud) == 16_000 and abs(np.abs(loud[2000:14_000]).max() - 0.5) < 0.01
    assert np.abs(audio.band_pass(np.sin(2 * math.pi * 50 * np.arange(16_000) / 16_000))).max() < 0.05
    assert audio.frame_rms(np.zeros(0)).tolist() == [] and len(audio.frame_rms(np.ones(100))) == 1


def test_log_summary(spark, tmp_path):
    (tmp_path / "log").write_text("".join(f"12:00 kind=final audio_dur=20.0 total_ms={100 * k} queue_ms=3.7 result=ready\n" for k in range(1, 6)) + "kind=final total_ms=9 result=dropped\nother line\n")
    got = {(r.kind, r.field): (r.n, r.p50, r.p95) for r in logs.summary(logs.timings(spark, str(tmp_path / "log"))).collect()}
    assert got == {("final", "total_ms"): (5, 300.0, 480.0), ("final", "queue_ms"): (5, 3.7, 3.7)}


def test_band_pass_is_the_textbook_filter():
    """Half power at both edges, none at the ends; the response is that of the difference equation; packets go on."""
    sections = audio.band_sections()
    at = lambda f: np.prod([np.polyval(s[2::-1], q) / np.polyval(s[:2:-1], q) for q in [np.exp(-2j * np.pi * f / 16_000)] for s in sections])
    assert abs(abs(at(300)) - 0.5**0.5) < 1e-9 and abs(abs(at(3400)) - 0.5**0.5) < 1e-9 and abs(at(0)) < 1e-12 and abs(at(8000)) < 1e-12 and abs(abs(at(1000)) - 1) < 1e-3
    x = np.zeros(1000)
    x[0] = 1.0
    want = x
    for b0, b1, b2, _, a1, a2 in sections:
        y = np.zeros(len(want))
        for i in range(len(y)):
            y[i] = b0 * want[i] + (b1 * want[i - 1] - a1 * y[i - 1] if i else 0) + (b2 * want[i - 2] - a2 * y[i - 2] if i > 1 else 0)
        want = y
    assert np.abs(audio.BandPass()(x) - want).max() < 1e-6
    noise = np.random.default_rng(1).normal(size=3000)
    band = audio.BandPass()
    parts = np.concatenate([band(noise[a:b]) for a, b in ((0, 3), (3, 700), (700, 701), (701, 3000))])
    assert np.abs(parts - audio.band_pass(noise)).max() < 1e-6


def test_repetitions_of_any_length():
    import random
    import re

    from utterlake.functions.text import collapsed

    r = random.Random(3)
    for k in range(400):
        unit = "".join(r.choice("ab" if k % 2 else "abcdefg ") for _ in range(r.randint(1, 12)))
        text = "".join(r.choice("abcx") for _ in range(r.randint(0, 6))) + unit * r.randint(1, 16) + unit[: r.randint(0, 3)] + "".join(r.choice(["ab", "x", "c" * 11, unit]) for _ in range(r.randint(0, 12)))
        want, at = [], 0
        while at < len(text):  # leftmost, then the shortest unit, as many copies as there are
            for size in range(1, (len(text) - at) // 10 + 1):
                n = 1
                while text.startswith(text[at : at + size], at + n * size):
                    n += 1
                if n >= 10:
                    want.append(text[at : at + size])
                    at += n * size
                    break
            else:
                want.append(text[at])
                at += 1
        assert collapsed(text) == "".join(want), text
        assert re.sub(r"(?s)(.{1,20}?)\1{9,}", r"\1", text) == "".join(want)
    long_ = "".join(r.choice("abcdefghij") for _ in range(700))
    assert collapsed("x" + long_ * 10 + "y") == "x" + long_ + "y" and collapsed(long_ * 9) == long_ * 9


def test_common_subsequence():
    import random

    from utterlake.functions.text import common_length

    r = random.Random(5)
    for _ in range(500):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for c in a:
            row = _row(row, b, c)
        assert common_length(a, b) == row[-1]


def _row(above, b, c):
    out = [0]
    for k in range(1, len(b) + 1):
        out.append(above[k - 1] + 1 if b[k - 1] == c else max(above[k], out[-1]))
    return out
