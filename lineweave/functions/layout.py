"""Layout of a line of text for template mode, given the sizes of its glyphs.

Drawing needs fonts, which plug in from outside: ``measure(kind, char)`` gives a glyph's (width, height),
``draw(kind, char)`` its alpha mask.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .pixels import erode

#: Texts of this length or more are matched in two halves.
SPLIT_LENGTH = 16
KERNING = 1


def glyph_kind(char: str) -> str:
    """Which of the three fonts a character is drawn in."""
    if char in string.ascii_letters or char in string.punctuation:
        return "alpha"
    return "digit" if char in string.digits else "japan"


@dataclass(frozen=True)
class Layout:
    """``starts``: left edges of the glyphs; ``cut``: where the halves meet, None for short texts."""

    width: int
    height: int
    starts: tuple[int, ...]
    cut: int | None


def layout(text: str, measure: Callable[[str, str], tuple[int, int]], kerning: int = KERNING, split: int = SPLIT_LENGTH) -> Layout:
    sizes = [measure(glyph_kind(c), c) for c in text]
    starts, at = [], 0
    for width, _ in sizes:
        starts.append(at)
        at += width + kerning
    half = len(text) // 2
    cut = starts[half] if len(text) >= split else None
    return Layout(max(0, at - kerning), max((h for _, h in sizes), default=0), tuple(starts), cut)


def template_parts(
    text: str,
    measure: Callable[[str, str], tuple[int, int]],
    draw: Callable[[str, str], np.ndarray],
    kerning: int = KERNING,
    split: int = SPLIT_LENGTH,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """(binary, mask) of a line, or of both its halves: bright pixels, and drawn pixels less their border."""
    plan = layout(text, measure, kerning, split)
    canvas = np.zeros((plan.height, plan.width), dtype=np.uint8)
    for char, left in zip(text, plan.starts, strict=True):
        glyph = draw(glyph_kind(char), char)
        top = (plan.height - glyph.shape[0]) // 2
        target = canvas[top : top + glyph.shape[0], left : left + glyph.shape[1]]
        np.maximum(target, glyph[: target.shape[0], : target.shape[1]], out=target)
    pieces = [canvas] if plan.cut is None else [canvas[:, : plan.cut], canvas[:, plan.cut :]]
    return [((p > 127).astype(np.uint8) * 255, erode(p > 30).astype(np.uint8)) for p in pieces]
