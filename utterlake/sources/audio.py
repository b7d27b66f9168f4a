"""Audio and packet sources: WAV files and PCM bytes to frames with an energy.

Files come through Spark's ``binaryFile`` reader; each is decoded in one Arrow batch row, and only frames
with their energies leave the task, so no signal is shuffled.
"""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE, FRAME, QUIET = 16_000, 512, 0.01


def pcm_to_float(raw: bytes) -> np.ndarray:
    """Signed 16-bit little-endian samples from -1 to 1."""
    return np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / 32768


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Band-limited change of rate: a windowed-sinc filter at the lower rate's edge."""
    if rate == to or not len(x):
        return x.astype(np.float32)
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    most = max(up, down)
    t = np.arange(-10 * most, 10 * most + 1) / most
    taps = np.sinc(t) * np.kaiser(len(t), 5.0)
    taps *= up / taps.sum()
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    return np.convolve(wide, taps, "same")[::down][: -(-len(x) * up // down)].astype(np.float32)


def decode_wav(raw: bytes) -> np.ndarray:
    """Mono samples at the target rate; channels are averaged."""
    with wave.open(io.BytesIO(raw)) as f:
        channels, width, rate = f.getnchannels(), f.getsampwidth(), f.getframerate()
        data = f.readframes(f.getnframes())
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif width == 2:
        x = pcm_to_float(data)
    else:
        x = np.frombuffer(data, f"<i{width}").astype(np.float32) / 2 ** (8 * width - 1)
    return resample(x.reshape(-1, channels).mean(axis=1), rate)


def frame_rms(x: np.ndarray, size: int = FRAME) -> np.ndarray:
    """Energy of each whole frame; a shorter signal is one frame, an empty one none."""
    if len(x) < size:
        x = x[None] if len(x) else np.zeros((0, 1))
    else:
        x = x[: len(x) // size * size].reshape(-1, size)
    return np.sqrt(np.mean(np.square(x, dtype=np.float64), axis=1)) if len(x) else np.zeros(0)


def band_sections(low: float = 300.0, high: float = 3400.0, rate: int = RATE, order: int = 4) -> np.ndarray:
    """Butterworth band pass as second-order sections (b0, b1, b2, 1, a1, a2), by the bilinear transform.

    The analogue poles of a low pass are moved to the band; all zeros end at the two ends of the spectrum.
    """
    w1, w2 = (2 * rate * math.tan(math.pi * f / rate) for f in (low, high))
    flat = np.exp(1j * math.pi * (2 * np.arange(order) + order + 1) / (2 * order)) * (w2 - w1) / 2
    spread = np.sqrt(flat**2 - w1 * w2)
    poles = np.concatenate([flat + spread, flat - spread])
    gain = ((w2 - w1) * 2 * rate) ** order / np.prod(2 * rate - poles).real
    z = (2 * rate + poles) / (2 * rate - poles)
    z = z[z.imag > 0]
    out = np.array([[1.0, 0.0, -1.0, 1.0, -2 * p.real, abs(p) ** 2] for p in sorted(z, key=abs)])
    out[0, :3] *= gain
    return out


class BandPass:
    """The telephone band of a stream of packets: the sections' state goes on from packet to packet.

    The cascade is one linear system; a block of samples is answered by its response to them and to the state.
    """

    def __init__(self, sections: np.ndarray | None = None, block: int = 256):
        sections = band_sections() if sections is None else sections
        n = 2 * len(sections)
        a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
        for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):
            # what comes in is c @ state + d * x of the sections before; direct form two, transposed
            i, j = 2 * k, 2 * k + 1
            a[i], a[j] = (b1 - a1 * b0) * c, (b2 - a2 * b0) * c
            a[i, i] -= a1
            a[i, j] += 1
            a[j, i] -= a2
            b[i], b[j] = (b1 - a1 * b0) * d, (b2 - a2 * b0) * d
            c, d = b0 * c, b0 * d
            c[i] += 1
        self.state, self.block = np.zeros(n), block
        powers = [np.eye(n)]
        for _ in range(block):
            powers.append(powers[-1] @ a)
        response = np.array([d, *(c @ p @ b for p in powers[:-1])])
        self.own = np.array([[response[i - j] if i >= j else 0.0 for j in range(block)] for i in range(block)])
        self.late = np.array([c @ p for p in powers[:block]])
        self.step, self.feed = powers, np.array([p @ b for p in powers[:block]])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for at in range(0, len(x), self.block):
            part = np.asarray(x[at : at + self.block], np.float64)
            n = len(part)
            out[at : at + n] = self.own[:n, :n] @ part + self.late[:n] @ self.state
            self.state = self.step[n] @ self.state + self.feed[:n][::-1].T @ part
        return out.astype(np.float32)


def band_pass(x: np.ndarray) -> np.ndarray:
    """A slice of its own in the telephone band."""
    return BandPass()(x)


def scan_wavs(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all WAV files under a path: source_id, frame_ix, rms, duration.  A file that is no WAV gives none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source, raw in zip(b["path"], b["content"], strict=True):
                try:
                    x = decode_wav(bytes(raw))
                except (wave.Error, EOFError):
                    continue
                rms = frame_rms(x)
                yield pd.DataFrame({"source_id": source, "frame_ix": np.arange(len(rms)), "rms": rms, "duration": len(x) / RATE})

    return files.mapInPandas(run, "source_id string, frame_ix long, rms double, duration double")


def silences(frames: DataFrame, quiet: float = QUIET) -> DataFrame:
    """Silences of each source in seconds: runs of frames that are not louder than ``quiet``; one at the end reaches the end."""
    from ..operators.intervals import islands

    hop = FRAME / RATE
    ends = frames.groupBy("source_id").agg(F.max("frame_ix").alias("last"), F.max("duration").alias("duration"))
    runs = islands(frames, "source_id", "frame_ix", "frame_ix", F.col("rms") <= quiet).join(ends, "source_id")
    end = F.when(F.col("end_us") == F.col("last"), F.col("duration")).otherwise(F.least((F.col("end_us") + 1) * hop, F.col("duration")))
    return runs.select("source_id", (F.col("start_us") * hop).alias("start"), end.alias("end"))
