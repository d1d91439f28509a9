"""Samples of several kinds: what is known about texts, images, sounds and videos. Nothing is decoded."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.text import n_chars, n_words


@dataclass(frozen=True)
class Text:
    text: str
    language: str | None = None
    charset: str = "utf-8"

    @property
    def counts(self) -> dict[str, int]:
        return {"chars": len(self.text), "bytes": len(self.text.encode()), "words": len(self.text.split()), "lines": len(self.text.splitlines())}


@dataclass(frozen=True)
class Image:
    width: int
    height: int
    channels: int = 3
    bits: int = 8
    format: str = "png"
    exif: dict[str, Any] = field(default_factory=dict)

    @property
    def aspect(self) -> float:
        return self.width / self.height if self.height else 0.0

    @property
    def raw_bytes(self) -> int:
        return self.width * self.height * self.channels * self.bits // 8


@dataclass(frozen=True)
class Audio:
    sample_rate: int
    channels: int
    seconds: float
    bits: int = 16
    codec: str = "pcm"
    voiced: tuple[tuple[float, float], ...] = ()

    @property
    def raw_bytes(self) -> int:
        return int(self.sample_rate * self.seconds) * self.channels * self.bits // 8

    @property
    def voiced_share(self) -> float:
        return sum(b - a for a, b in self.voiced) / self.seconds if self.seconds else 0.0


@dataclass(frozen=True)
class Video:
    frame: Image
    fps: float
    seconds: float
    codec: str = "h264"
    keyframes: tuple[int, ...] = ()
    sound: Audio | None = None

    @property
    def frames(self) -> int:
        return int(self.fps * self.seconds)

    @property
    def raw_bytes(self) -> int:
        return self.frames * self.frame.raw_bytes + (self.sound.raw_bytes if self.sound else 0)


@dataclass(frozen=True)
class Sample:
    uid: str
    parts: tuple[Text | Image | Audio | Video, ...]
    metadata: dict[str, Any] = field(default_factory=dict)
    #: (part, start, end) on a common time line
    alignment: tuple[tuple[int, float, float], ...] = ()

    @property
    def kind(self) -> str:
        kinds = {type(p).__name__ for p in self.parts}
        return kinds.pop() if len(kinds) == 1 else "MultiModal"


def text_counts(c: Column) -> Column:
    """chars, bytes, words and lines of a text column."""
    lines = F.when(c == "", 0).otherwise(F.regexp_count(F.regexp_replace(c, r"\n\z", ""), F.lit("\n")) + 1).cast("bigint")
    return F.struct(n_chars(c).alias("chars"), F.octet_length(c).cast("bigint").alias("bytes"), n_words(c).alias("words"), lines.alias("lines"))
