"""Template mode: each line in turn is looked for from where the one before it ended."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass


class NotFound(ValueError):
    """A line is not on any frame that is left."""


@dataclass(frozen=True)
class Placed:
    index: int
    start_frame: int
    end_frame: int


class LinePlacer:
    """Feed frames in order, then ``close``; both give the lines that are placed by then.

    A line starts on the first frame from the cursor on that shows it and ends before k frames in a row without it, at
    the end of the recording otherwise; the next one is looked for from there.  ``gaps`` are frames to pass over
    before a line.  The last k frames are kept, since the next line may begin among them.
    """

    def __init__(self, lines: int, k: int = 3, gaps: dict[int, int] | None = None) -> None:
        self.lines, self.k, self.gaps = lines, k, gaps or {}
        self.line, self.cursor = 0, self.gaps.get(0, 0)
        self.start: int | None = None
        self.misses = 0
        self.next_index = 0
        self.recent: deque[tuple[int, Callable[[int], bool]]] = deque(maxlen=k)

    def feed(self, shows: Callable[[int], bool]) -> Iterator[Placed]:
        """One more frame; ``shows(line)`` tells whether it shows a line."""
        waiting = deque([(self.next_index, shows)])
        self.next_index += 1
        while waiting and self.line < self.lines:
            index, here = waiting.popleft()
            self.recent.append((index, here))
            if index < self.cursor:
                continue
            if self.start is None:
                if here(self.line):
                    self.start, self.misses = index, 0
                continue
            self.misses = 0 if here(self.line) else self.misses + 1
            if self.misses == self.k:
                end = index - self.k + 1
                yield self._placed(end)
                # those frames may show the next line
                waiting.extendleft(reversed([f for f in self.recent if f[0] >= end]))
                self.recent.clear()

    def close(self) -> Iterator[Placed]:
        """End of the recording."""
        if self.start is not None:
            yield self._placed(self.next_index)

    def _placed(self, end: int) -> Placed:
        placed = Placed(self.line, self.start, end)
        self.line += 1
        self.cursor, self.start = end + self.gaps.get(self.line, 0), None
        return placed


def place_lines(
    shown: Callable[[int, int], bool], lines: int, frames: int, k: int = 3, gaps: dict[int, int] | None = None, strict: bool = True
) -> Iterator[Placed]:
    """Place ``lines`` lines on ``frames`` frames; ``shown(line, frame)`` tells whether a frame shows a line.

    Without ``strict`` a line that is not found ends the search.
    """
    placer = LinePlacer(lines, k, gaps)
    for frame in range(frames):
        yield from placer.feed(lambda line, frame=frame: shown(line, frame))
    yield from placer.close()
    if strict and placer.line < lines:
        raise NotFound(f"line {placer.line} is not found")
