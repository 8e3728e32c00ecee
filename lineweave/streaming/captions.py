"""Captions without a script: whatever is read steadily inside given regions of a recording."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from ..config import Options, supplement_options
from ..functions.pixels import Template, same_glyphs
from ..functions.text import bare
from .frames import Frame, History, Seen, Track, walk_back

#: A retry must keep this share of the raw reading's width.
WIDTH_SHARE = 0.95
#: Score from which a frame counts as unchanged, whatever is read in it.
UNCHANGED = 0.98
OLD_SLACK = 0.01


@dataclass
class Region:
    start_frame: int
    end_frame: int
    assets: tuple[str, ...] = ()


@dataclass
class Held:
    key: str
    count: int
    time: float
    anchor: int
    template: Template
    best: Seen


@dataclass
class Open:
    row: dict
    key: str
    track: Track
    confirmed: int
    glyphs: np.ndarray

    def note(self, seen: Seen, frame: Frame) -> bool:
        """One more observation; whether it is the best one so far."""
        self.row["observations"] += 1
        self.confirmed = frame.index
        better = seen.confidence > self.row["ocr_confidence"]
        if better:
            self.row |= {"text": seen.text, "ocr_confidence": seen.confidence, "ocr_model": seen.model}
        return better


class CaptionExtractor:
    """Feed frames in order, then ``close``; ``rows`` has the captions in the order in which they ended."""

    def __init__(self, regions: Sequence[Region], fps: float, options: Options | None = None) -> None:
        self.options = options or supplement_options(Options())
        self.fps = fps
        self.regions = list(regions)
        self.region = 0
        self.history = History(self.options.buffer_seconds, self.options.max_buffer_frames)
        self.stats = {"frames": 0, "ocr_calls": 0, "rejected_readings": 0, "peak_buffer_frames": 0}
        self.open: Open | None = None
        self.held: Held | None = None
        self.last_read: float | None = None
        self.floor, self.last_index = 0, -1
        self.rows: list[dict] = []

    def feed(self, frame: Frame) -> None:
        self.last_index = frame.index
        while self.region < len(self.regions) and frame.index >= self.regions[self.region].end_frame:
            self._close(self.regions[self.region].end_frame, "region_end")
            self.region += 1
            self.history.clear()
            self.held = self.last_read = None
        if self.region >= len(self.regions) or frame.index < self.regions[self.region].start_frame:
            return
        self.floor = max(self.floor, self.regions[self.region].start_frame)
        self.stats["frames"] += 1
        self.history.add(frame)
        self.stats["peak_buffer_frames"] = self.history.peak
        mask = frame.mask
        if self.open is not None:
            self.open.track.follow(frame, mask, self.options.track_threshold)
            if self.open.track.misses >= self.options.end_confirm_frames:
                self._close(self.open.track.first_miss, "visual_change")
                self.held = None
        calm = self.open is not None and self.held is None
        wait = self.options.recheck_interval if calm else self.options.ocr_interval
        if self.last_read is None or frame.time - self.last_read >= wait:
            self.last_read = frame.time
            self._read(frame, mask)

    def close(self) -> list[dict]:
        """End of input."""
        if self.open is not None:
            end = self.open.track.last_seen(self.last_index)
            self._close(min(end, self.regions[self.region].end_frame), "video_end")
        return self.rows

    def usable(self, seen: Seen | None) -> bool:
        return (
            seen is not None
            and seen.confident(self.options.min_confidence)
            and len(bare(seen.text)) >= 2
            and any(c.isalpha() for c in seen.text)
        )

    def _recognise(self, frame: Frame) -> tuple[Seen | None, int]:
        """The reading to go by and how many attempts agree with it."""
        self.stats["ocr_calls"] += 1
        raw = frame.primary
        known = self.open is not None and raw is not None and bare(raw.text) == self.open.key
        if raw is None or (self.usable(raw) and known):
            return raw, 1
        width = max(1, raw.box[2] - raw.box[0])
        tried = [raw] if self.usable(raw) else []
        retries = frame.attempts[1:3]
        self.stats["ocr_calls"] += 2
        tried += [r for r in retries if self.usable(r) and r.box[2] - r.box[0] >= WIDTH_SHARE * width]
        if not tried:
            return raw, 1
        best = max(tried, key=lambda r: r.confidence)
        return best, sum(bare(r.text) == bare(best.text) for r in tried)

    def _read(self, frame: Frame, mask: np.ndarray) -> None:
        seen, agreeing = self._recognise(frame)
        if not self.usable(seen):
            self.stats["rejected_readings"] += 1
            self.held = None
            return
        key = bare(seen.text)
        if self.open is not None and self._belongs(frame, mask, seen, key, agreeing):
            self.held = None
            return
        template = Template.cut(mask, seen.box)
        if not template.valid:
            self.held = None
            return
        self._confirm(frame, mask, seen, key, template)

    def _belongs(self, frame: Frame, mask: np.ndarray, seen: Seen, key: str, agreeing: int) -> bool:
        """Whether a reading is one more of the open caption, or a fluctuation over it."""
        current = self.open
        if key == current.key:
            current.note(seen, frame)
            return True
        x0, y0, x1, y1 = current.track.template.box
        if same_glyphs(current.glyphs[y0:y1, x0:x1], frame.signature[y0:y1, x0:x1]):
            if current.note(seen, frame):
                current.key = key
            return True
        return current.track.template.score(mask) >= UNCHANGED and agreeing < 2

    def _confirm(self, frame: Frame, mask: np.ndarray, seen: Seen, key: str, template: Template) -> None:
        options, held = self.options, self.held
        if (
            held is not None
            and held.key == key
            and frame.time - held.time <= 2 * options.recheck_interval
            and held.template.score(mask) >= options.track_threshold
        ):
            held.count += 1
            held.time = frame.time
            if seen.confidence > held.best.confidence:
                held.best = seen
        else:
            held = self.held = Held(key, 1, frame.time, frame.index, template, seen)
        if held.count < options.confirmations:
            return
        start, limited = self._onset(held)
        if self.open is not None:
            start = max(start, self.open.confirmed + 1)
            self._close(start, "ocr_transition")
        best = held.best
        row = {
            "status": "ocr_only",
            "source": "movie_ocr",
            "needs_review": True,
            "text": best.text,
            "start_frame": start,
            "start": start / self.fps,
            "ocr_confidence": best.confidence,
            "ocr_model": best.model,
            "observations": held.count,
            "onset_buffer_limited": limited,
            "movie_assets": list(self.regions[self.region].assets),
            "ocr_box": list(best.box),
        }
        self.open = Open(row, key, Track(template), frame.index, frame.signature)
        self.held = None

    def _onset(self, held: Held) -> tuple[int, bool]:
        options, current = self.options, self.open
        frames = [f for f in self.history.kept if self.floor <= f.index <= held.anchor]

        def present(mask: np.ndarray) -> float:
            score = held.template.score(mask)
            if current is not None:
                before = current.track.template.score(mask)
                if before >= options.track_threshold and before >= score - OLD_SLACK:
                    return 0.0
            return score

        start = walk_back(frames, held.anchor, present, options.onset_threshold, options.end_confirm_frames)
        return start, bool(frames) and start == frames[0].index and start > self.floor

    def _close(self, end: int, reason: str) -> None:
        if self.open is None:
            return
        row = self.open.row
        row["end_frame"] = max(row["start_frame"] + 1, end)
        row["end"] = row["end_frame"] / self.fps
        row["end_reason"] = reason
        self.rows.append(row)
        self.floor, self.open = row["end_frame"], None
