"""Settings from an environment with typed fallbacks, and all broken constraints at once."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from .operators.planner import SplitConfig
from .streaming.realtime import Limits


@dataclass(frozen=True)
class Settings:
    """Names are read in upper case with a prefix; a value that does not parse falls back to the default."""

    max_utterance_s: float = 20.0
    soft_cut_start_s: float = 12.0
    soft_cut_silence_ms: int = 500
    flush_silence_ms: int = 600
    early_silence_ms: int = 1000
    offline_target_s: float = 35.0
    offline_search_s: float = 5.0
    offline_max_chunk_s: float = 40.0
    hard_overlap_s: float = 1.5
    silence_overlap_s: float = 0.4
    vad_hangover_ms: int = 800
    pre_roll_ms: int = 800
    vad_end_max_silence_ms: int = 1200
    partial_ms: int = 1500
    hotword_threshold: float = 0.85
    itn: bool = True

    def broken(self) -> list[str]:
        """Every constraint that does not hold."""
        tests = {
            "soft_cut_start_s < max_utterance_s": self.soft_cut_start_s < self.max_utterance_s,
            "soft_cut_silence_ms < flush_silence_ms": self.soft_cut_silence_ms < self.flush_silence_ms,
            "offline_target_s < offline_max_chunk_s": self.offline_target_s < self.offline_max_chunk_s,
            "hard_overlap_s < offline_max_chunk_s": self.hard_overlap_s < self.offline_max_chunk_s,
            "silence_overlap_s < offline_max_chunk_s": self.silence_overlap_s < self.offline_max_chunk_s,
            "0 <= vad_hangover_ms": self.vad_hangover_ms >= 0,
            "0 <= pre_roll_ms": self.pre_roll_ms >= 0,
            "0 < partial_ms": self.partial_ms > 0,
            "0 < hotword_threshold <= 1": 0 < self.hotword_threshold <= 1,
        }
        return [text for text, holds in tests.items() if not holds]

    def checked(self) -> Settings:
        """These settings, or an error that names every constraint that does not hold."""
        if broken := self.broken():
            raise ValueError("; ".join(broken))
        return self

    def split(self) -> SplitConfig:
        """How offline recordings are cut."""
        return SplitConfig(target=self.offline_target_s, search=self.offline_search_s, max_chunk=self.offline_max_chunk_s, hard_overlap=self.hard_overlap_s, silence_overlap=self.silence_overlap_s)

    def limits(self) -> Limits:
        """The realtime fold's times."""
        return Limits(
            end_silence=self.flush_silence_ms, early_silence=self.early_silence_ms, grace=self.vad_end_max_silence_ms, hangover=self.vad_hangover_ms, pre_roll=self.pre_roll_ms, partial=self.partial_ms,
            longest=round(1000 * self.max_utterance_s), soft_after=round(1000 * self.soft_cut_start_s), soft_silence=self.soft_cut_silence_ms,
        )


def load(env: Mapping[str, str] | None = None, prefix: str = "UTTERLAKE_") -> Settings:
    env, found = os.environ if env is None else env, {}
    for f in fields(Settings):
        raw = env.get(prefix + f.name.upper())
        if raw is None:
            continue
        try:
            found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if f.type == "bool" else {"int": int, "float": float}[f.type](raw)
        except ValueError:
            continue
    return Settings(**found)
