"""Alignment of a recording's frames to the lines of a known script, one frame at a time.

Recognition decides which line is on screen, edge tracking decides when.  A script's durations only
lower the number of confirmations that a short line needs; they never set a time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from ..config import Options
from ..functions.pixels import Template, change_ratio
from ..functions.text import match_form
from .frames import Frame, History, Seen, Track, walk_back

NO_MATCH, SKIPPED = "no_confident_ocr_match", "skipped_by_sequence_alignment"
#: Texts of this length or less must be read exactly.
EXACT_LENGTH = 4
#: By how much an old template must beat a new one's full score to claim a frame.
OLD_LEAD = 0.05


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time as bit vectors."""
    if not a or not b:
        return max(len(a), len(b))
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for c in b:
        equal = places.get(c, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        plus = down | ~(horizontal | up) & full
        minus = up & horizontal
        distance += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 | 1, minus << 1
        up = (minus | ~(vertical | plus)) & full
        down = plus & vertical & full
    return distance


@lru_cache(maxsize=1024)
def likeness(a: str, b: str) -> float:
    """A line is read many times, often in the same words, so the last results are kept."""
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 1 - edit_distance(a, b) / max(len(a), len(b))


def most_alike(a: str, b: str) -> float:
    """What ``likeness`` cannot exceed, by the lengths alone."""
    return min(len(a), len(b)) / max(len(a), len(b))


def choose(read: str, lines: Sequence[str], first: int, end: int, options: Options) -> tuple[int, float] | None:
    """The line in first:end that a reading stands for, and how alike they are; None if none is clear.

    All texts are in matching form.
    """
    # a score under this can neither win nor come too close to a winner
    least = options.min_similarity - options.candidate_margin - 1e-9
    near = [i for i in range(first, min(end, len(lines))) if read and lines[i] and most_alike(read, lines[i]) >= least]
    scores = [(likeness(read, lines[i]), i) for i in near]
    if not scores:
        return None
    score, index = max(scores, key=lambda s: (s[0], -s[1]))
    line = lines[index]
    if score < options.min_similarity or (min(len(read), len(line)) <= EXACT_LENGTH and read != line):
        return None
    rival = max((s for s, i in scores if lines[i] != line), default=None)
    return None if rival is not None and score - rival < options.candidate_margin else (index, score)


@dataclass
class Pending:
    index: int
    count: int
    time: float
    anchor: int
    template: Template


class LineAligner:
    """Feed frames in order, then ``close``; ``results`` has one row per line."""

    def __init__(
        self,
        lines: Sequence[tuple[str, float]],
        fps: float,
        options: Options | None = None,
        gaps: Mapping[int, float] | None = None,
    ) -> None:
        self.options = options or Options()
        self.fps = fps
        self.durations = [d for _, d in lines]
        self.keys = [match_form(t) for t, _ in lines]
        #: Seconds to pass over before a line; ``ahead`` has those that are still to come.
        self.gaps = dict(gaps or {})
        self.ahead = set(self.gaps)
        self.results: list[dict] = [
            {"idx": i, "text": t, "status": "unmatched", "reason": NO_MATCH} for i, (t, _) in enumerate(lines)
        ]
        self.history = History(self.options.buffer_seconds, self.options.max_buffer_frames)
        self.stats = {"frames": 0, "ocr_calls": 0, "peak_buffer_frames": 0, "peak_buffer_bytes": 0}
        self.cursor, self.done = 0, False
        self.active: int | None = None
        self.track: Track | None = None
        self.pending: Pending | None = None
        self.previous: np.ndarray | None = None
        self.stable, self.dirty = 0, True
        self.last_read: float | None = None
        self.search_from, self.last_index = 0.0, -1

    def feed(self, frame: Frame) -> None:
        if self.done:
            return
        self.stats["frames"] += 1
        self.last_index = frame.index
        if self._placed_all():
            return
        if self.active is None and self.cursor in self.ahead:
            self.search_from += self.gaps[self.cursor]
            self.ahead.remove(self.cursor)
            self.history.clear()
            self.pending = None
        if frame.time < self.search_from:
            return
        mask = frame.mask
        self._observe(frame, mask)
        if self.track is not None:
            self.track.follow(frame, mask, self.options.track_threshold)
            if self.track.misses >= self.options.end_confirm_frames:
                self._close(self.track.first_miss, "visual_change")
                self.pending, self.dirty = None, True
                if self.cursor in self.ahead:
                    return
        if not self._placed_all() and self._due(frame):
            self._read(frame, mask)

    def close(self) -> list[dict]:
        """End of input."""
        if self.track is not None:
            self._close(self.track.last_seen(self.last_index), "video_end")
        self.done = True
        return self.results

    def _placed_all(self) -> bool:
        self.done = self.cursor >= len(self.results)
        return self.done

    def _observe(self, frame: Frame, mask: np.ndarray) -> None:
        self.history.add(frame)
        self.stats["peak_buffer_frames"] = max(self.stats["peak_buffer_frames"], len(self.history.kept))
        self.stats["peak_buffer_bytes"] = max(self.stats["peak_buffer_bytes"], len(self.history.kept) * mask.size)
        changed = change_ratio(self.previous, mask) >= self.options.change_threshold
        self.previous = mask
        self.stable = 0 if changed else self.stable + 1
        self.dirty |= changed

    def _due(self, frame: Frame) -> bool:
        elapsed = float("inf") if self.last_read is None else frame.time - self.last_read
        if elapsed < self.options.ocr_interval:
            return False
        if elapsed >= self.options.recheck_interval or self.track is None or self.pending is not None:
            return True
        return self.dirty and self.stable >= self.options.stable_frames

    def _barrier(self) -> int:
        """No line at or behind the next gap may be matched."""
        return min((i for i in self.gaps if i > self.cursor), default=len(self.results))

    def _candidate(self, seen: Seen | None) -> tuple[int, float] | None:
        if seen is None or not seen.confident(self.options.min_confidence):
            return None
        end = min(self.cursor + self.options.lookahead, self._barrier())
        return choose(match_form(seen.text), self.keys, self.cursor, end, self.options)

    def _read(self, frame: Frame, mask: np.ndarray) -> None:
        self.last_read, self.dirty = frame.time, False
        self.stats["ocr_calls"] += 1
        seen = frame.primary
        found = self._candidate(seen)
        if found is None and seen is not None:
            for other in frame.attempts[1:]:
                self.stats["ocr_calls"] += 1
                found = self._candidate(other)
                if found is not None:
                    seen = other
                    break
        if found is None or found[0] == self.active:
            self.pending = None
            return
        template = Template.cut(mask, seen.box)
        if not template.valid:
            self.pending = None
            return
        self._confirm(frame, seen, *found, template)

    def _confirm(self, frame: Frame, seen: Seen, index: int, score: float, template: Template) -> None:
        options, held = self.options, self.pending
        if held is not None and held.index == index and frame.time - held.time <= 2 * options.recheck_interval:
            held.count += 1
            held.time = frame.time
        else:
            held = self.pending = Pending(index, 1, frame.time, frame.index, template)
        sure = (
            0 < self.durations[index] <= options.short_line_seconds
            and score >= 0.999
            and seen.confidence >= 0.95
            and len(self.keys[index]) >= 5
            and self.stable >= options.stable_frames
        )
        if held.count < options.confirmations and not sure:
            self.dirty = True
            return
        start, limited = self._onset(held)
        if self.track is not None:
            self._close(start, "ocr_transition")
        for skipped in range(self.cursor, index):
            self.results[skipped]["reason"] = SKIPPED
        self.cursor = index
        row = self.results[index]
        row.pop("reason", None)
        row |= {
            "status": "matched",
            "start_frame": start,
            "start": start / self.fps,
            "ocr_text": seen.text,
            "ocr_model": seen.model,
            "ocr_confidence": seen.confidence,
            "text_similarity": score,
            "onset_buffer_limited": limited,
        }
        # the first template finds the onset, the latest one is tracked
        self.active, self.track, self.pending = index, Track(template), None

    def _onset(self, held: Pending) -> tuple[int, bool]:
        options, old = self.options, self.track
        frames = [f for f in self.history.kept if self.search_from <= f.time and f.index <= held.anchor]

        def present(mask: np.ndarray) -> float:
            full = held.template.score(mask)
            if old is not None:
                before = old.template.score(mask)
                if before >= options.track_threshold and before > full + OLD_LEAD:
                    return 0.0
            return max(full, held.template.score(mask, prefix=True))

        start = walk_back(frames, held.anchor, present, options.onset_threshold, options.end_confirm_frames)
        oldest = frames[0] if frames else None
        limited = oldest is not None and start == oldest.index and oldest.time > self.search_from + 1 / self.fps
        return start, limited

    def _close(self, end: int, reason: str) -> None:
        row = self.results[self.active]
        row["end_frame"] = max(row["start_frame"] + 1, end)
        row["end"] = row["end_frame"] / self.fps
        row["end_reason"] = reason
        self.cursor, self.search_from = self.active + 1, row["end"]
        self.active = self.track = None
