"""What the state machines are fed: frames with bit-packed masks and the readings they may ask for."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

import numpy as np

from ..functions.pixels import Template, unpack_mask


@dataclass(frozen=True)
class Seen:
    """One attempt to read a frame."""

    text: str
    confidence: float
    box: tuple[int, int, int, int]
    model: str = ""

    def confident(self, least: float) -> bool:
        return math.isfinite(self.confidence) and self.confidence >= least


@dataclass
class Frame:
    """``attempts[0]`` is the primary reading (or None), the rest are its alternatives in order."""

    index: int
    time: float
    h: int
    w: int
    edge: bytes
    attempts: list[Seen | None] = field(default_factory=list)
    glyphs: bytes | None = None
    #: The edges unpacked, where a whole batch was.
    unpacked: np.ndarray | None = None

    @property
    def mask(self) -> np.ndarray:
        return unpack_mask(self.edge, self.h, self.w) if self.unpacked is None else self.unpacked

    @property
    def signature(self) -> np.ndarray:
        """The glyph mask; the edges stand in where there is none."""
        return unpack_mask(self.glyphs if self.glyphs is not None else self.edge, self.h, self.w)

    @property
    def primary(self) -> Seen | None:
        return self.attempts[0] if self.attempts else None


class History:
    """Recent masks, bounded by age and by number."""

    def __init__(self, seconds: float, limit: int) -> None:
        self.seconds = seconds
        self.kept: deque[Frame] = deque(maxlen=limit)
        self.peak = 0

    def add(self, frame: Frame) -> None:
        self.kept.append(Frame(frame.index, frame.time, frame.h, frame.w, frame.edge))
        while frame.time - self.kept[0].time > self.seconds:
            self.kept.popleft()
        self.peak = max(self.peak, len(self.kept))

    def clear(self) -> None:
        self.kept.clear()


@dataclass
class Track:
    """What is on screen: its template, and the run of frames in which it was not seen."""

    template: Template
    misses: int = 0
    first_miss: int = -1

    def follow(self, frame: Frame, mask: np.ndarray, threshold: float) -> None:
        if self.template.score(mask) >= threshold:
            self.misses = 0
        else:
            if not self.misses:
                self.first_miss = frame.index
            self.misses += 1

    def last_seen(self, last_index: int) -> int:
        """Where it ends if nothing more comes."""
        return self.first_miss if self.misses else last_index + 1


def walk_back(frames: list[Frame], anchor: int, present, threshold: float, k: int) -> int:
    """The earliest of ``frames`` (in order, up to the anchor) that shows it, before k in a row that do not."""
    start, misses = anchor, 0
    for frame in reversed(frames):
        if present(frame.mask) >= threshold:
            start, misses = frame.index, 0
        else:
            misses += 1
            if misses >= k:
                break
    return start
