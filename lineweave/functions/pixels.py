"""Pixel kernels in NumPy: edges, masks, overlap scores, template matching.

Edge masks travel bit-packed (``pack_mask``).  No image library is needed; decoders, recognisers
and fonts plug in from outside.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

MIN_EDGE = 10
MIN_OVERLAP = 5
MIN_WHITE = 100


def pack_mask(mask: np.ndarray) -> bytes:
    return np.packbits(np.asarray(mask, dtype=bool)).tobytes()


def unpack_mask(data: bytes, h: int, w: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=h * w).reshape(h, w).astype(bool)


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of a BGR image."""
    if image.ndim == 2:
        return image
    b, g, r = (image[..., k].astype(np.float64) for k in range(3))
    return np.clip(np.rint(0.114 * b + 0.587 * g + 0.299 * r), 0, 255).astype(np.uint8)


def roi_bounds(roi: tuple[float, float, float, float], width: int, height: int) -> tuple[int, int, int, int]:
    """Pixel bounds of a fractional box, truncated; at least three pixels each way."""
    left, top, right, bottom = (int(f * n) for f, n in zip(roi, (width, height, width, height), strict=True))
    if right - left < 3 or bottom - top < 3:
        raise ValueError("the region has fewer than three pixels")
    return left, top, right, bottom


def dilate(mask: np.ndarray) -> np.ndarray:
    """Union of the nine shifts of a mask by one pixel."""
    padded = np.pad(mask, 1)
    h, w = mask.shape
    out = np.zeros_like(mask)
    for dy in range(3):
        for dx in range(3):
            out |= padded[dy : dy + h, dx : dx + w]
    return out


def erode(mask: np.ndarray) -> np.ndarray:
    """What stays set in all nine shifts; beyond the border counts as set."""
    return ~dilate(~mask)


def open3(mask: np.ndarray) -> np.ndarray:
    return dilate(erode(mask))


def binarise(image: np.ndarray, threshold: int) -> np.ndarray:
    return gray(image) > threshold


def adaptive_binarise(image: np.ndarray, block: int = 11, offset: float = 0.0) -> np.ndarray:
    """Above the Gaussian mean of a block around the pixel, less ``offset``; the border repeats its pixels."""
    values = gray(image)
    half = block // 2
    sigma = 0.3 * (half - 1) + 0.8
    weights = np.exp(-((np.arange(block) - half) ** 2) / (2 * sigma * sigma))
    weights /= weights.sum()
    padded = np.pad(values.astype(np.float64), half, mode="edge")
    across = np.lib.stride_tricks.sliding_window_view(padded, block, axis=1) @ weights
    mean = np.rint(np.lib.stride_tricks.sliding_window_view(across, block, axis=0) @ weights)
    return values > mean - offset


def canny(image: np.ndarray, low: int = 60, high: int = 160) -> np.ndarray:
    """Edges: 3x3 Sobel gradients, thinning along the gradient, hysteresis over 8-neighbours."""
    v = np.pad(gray(image).astype(np.int32), 1, mode="edge")
    gx = (v[:-2, 2:] + 2 * v[1:-1, 2:] + v[2:, 2:]) - (v[:-2, :-2] + 2 * v[1:-1, :-2] + v[2:, :-2])
    gy = (v[2:, :-2] + 2 * v[2:, 1:-1] + v[2:, 2:]) - (v[:-2, :-2] + 2 * v[:-2, 1:-1] + v[:-2, 2:])
    size = np.abs(gx) + np.abs(gy)
    m = np.pad(size, 1)
    centre = m[1:-1, 1:-1]
    at = lambda dy, dx: m[1 + dy : m.shape[0] - 1 + dy, 1 + dx : m.shape[1] - 1 + dx]
    ax, ay = np.abs(gx), np.abs(gy)
    flat, steep = ay * 2.414213562 < ax, ay > ax * 2.414213562
    falling = (gx < 0) != (gy < 0)
    peak = np.where(
        flat,
        (centre > at(0, -1)) & (centre >= at(0, 1)),
        np.where(
            steep,
            (centre > at(-1, 0)) & (centre >= at(1, 0)),
            np.where(falling, (centre > at(-1, 1)) & (centre > at(1, -1)), (centre > at(-1, -1)) & (centre > at(1, 1))),
        ),
    )
    weak = peak & (size > low)
    strong = weak & (size > high)
    while True:
        grown = dilate(strong) & weak
        if (grown == strong).all():
            return strong
        strong = grown


def overlap(reference: np.ndarray, current: np.ndarray) -> float:
    """F-score of two masks with a tolerance of one pixel; 0 where either has fewer than MIN_OVERLAP pixels."""
    a, b = int(reference.sum()), int(current.sum())
    if min(a, b) < MIN_OVERLAP:
        return 0.0
    recall = float((reference & dilate(current)).sum()) / a
    precision = float((current & dilate(reference)).sum()) / b
    return 2 * recall * precision / max(recall + precision, 1e-9)


def change_ratio(previous: np.ndarray | None, current: np.ndarray) -> float:
    """Differing pixels over set pixels; 1 for a first mask or another shape."""
    if previous is None or previous.shape != current.shape:
        return 1.0
    return int((previous ^ current).sum()) / max(int((previous | current).sum()), 1)


def same_glyphs(previous: np.ndarray, current: np.ndarray, limit: float = 0.02, least: int = 10) -> bool:
    union = int((previous | current).sum())
    return union >= least and int((previous ^ current).sum()) / union < limit


@dataclass
class Template:
    """The edges inside a box (x0, y0, x1, y1), clipped to the mask."""

    box: tuple[int, int, int, int]
    mask: np.ndarray

    @classmethod
    def cut(cls, mask: np.ndarray, box: tuple[int, int, int, int]) -> Template:
        h, w = mask.shape
        x0, y0, x1, y1 = max(0, box[0]), max(0, box[1]), min(w, box[2]), min(h, box[3])
        return cls((x0, y0, x1, y1), mask[y0:y1, x0:x1].copy())

    @property
    def valid(self) -> bool:
        return self.mask.size > 0 and int(self.mask.sum()) >= MIN_EDGE

    def score(self, mask: np.ndarray, prefix: bool = False) -> float:
        """Overlap with the same box of another mask; ``prefix`` compares the first quarter only."""
        if not self.valid:
            return 0.0
        x0, y0, x1, y1 = self.box
        part = mask[y0:y1, x0:x1]
        if part.shape != self.mask.shape:
            return 0.0
        if prefix:
            width = max(1, part.shape[1] // 4)
            return overlap(self.mask[:, :width], part[:, :width])
        return overlap(self.mask, part)


def correlate(frame: np.ndarray, template: np.ndarray, mask: np.ndarray) -> float:
    """The largest normalised correlation of a masked template over all placements."""
    fh, fw = frame.shape
    th, tw = template.shape
    if not th or not tw or th > fh or tw > fw or not mask.any():
        return 0.0
    view = np.lib.stride_tricks.sliding_window_view(frame.astype(np.float64), (th, tw))
    weight = mask.astype(np.float64)
    t = template.astype(np.float64) * weight
    norm = np.sqrt((t * t).sum())
    product = np.einsum("ijkl,kl->ij", view, t)
    energy = np.sqrt(np.einsum("ijkl,kl->ij", view * view, weight))
    with np.errstate(divide="ignore", invalid="ignore"):
        result = product / (norm * energy)
    return float(np.where(np.isfinite(result), result, 0).max())


def matches_template(frame: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], threshold: float = 0.7) -> bool:
    """Whether the mean of the parts' best correlations is over the threshold."""
    if int((frame > 0).sum()) < MIN_WHITE or not parts:
        return False
    for template, mask in parts:
        if not template.size or template.shape[0] > frame.shape[0] or template.shape[1] > frame.shape[1] or not mask.any():
            return False
    return sum(correlate(frame, t, m) for t, m in parts) / len(parts) > threshold


def fill_holes(dark: np.ndarray) -> np.ndarray:
    """Dark pixels with what they enclose: all that the border cannot reach over light pixels (4-neighbours)."""
    outside = np.zeros((dark.shape[0] + 2, dark.shape[1] + 2), dtype=bool)
    light = np.pad(~dark, 1, constant_values=True)
    outside[0, 0] = True
    while True:
        grown = outside.copy()
        grown[1:] |= outside[:-1]
        grown[:-1] |= outside[1:]
        grown[:, 1:] |= outside[:, :-1]
        grown[:, :-1] |= outside[:, 1:]
        grown &= light
        if (grown == outside).all():
            return ~outside[1:-1, 1:-1]
        outside = grown


def outlined_text(image: np.ndarray, threshold: int = 40) -> np.ndarray:
    """Light glyph interiors enclosed by dark outlines, dark on white."""
    dark = gray(image) <= threshold
    return np.where(fill_holes(dark) & ~dark, 0, 255).astype(np.uint8)


@F.pandas_udf(DoubleType())
def edge_overlap(left: pd.Series, right: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """``overlap`` of two bit-packed masks."""
    rows = zip(left, right, h, w, strict=True)
    return pd.Series([overlap(unpack_mask(a, y, x), unpack_mask(b, y, x)) for a, b, y, x in rows], dtype="float64")


@F.pandas_udf(DoubleType())
def mask_change(left: pd.Series, right: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """``change_ratio`` of two bit-packed masks; a null left side is no mask."""
    rows = zip(left, right, h, w, strict=True)
    return pd.Series(
        [change_ratio(None if a is None else unpack_mask(a, y, x), unpack_mask(b, y, x)) for a, b, y, x in rows],
        dtype="float64",
    )
