"""Frame scans: tables of frames, ranged scans, and pluggable decoders and recognisers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import adaptive_binarise, canny, open3, pack_mask, roi_bounds


@dataclass(frozen=True)
class Reading:
    """What a recogniser saw."""

    text: str
    confidence: float
    box: tuple[int, int, int, int]
    model: str


class Recogniser(Protocol):
    def read(self, image: np.ndarray) -> Reading | None: ...

    def alternatives(self, image: np.ndarray) -> Iterator[Reading | None]: ...


#: Frames of a stretch; regions are listed by the stretches that they touch.
STRETCH = 4096


def ranged_frames(frames: DataFrame, regions: DataFrame) -> DataFrame:
    """Frames (video_id, frame_index, ...) inside regions (video_id, start_frame, end_frame).

    A frame is compared with the regions of its stretch of STRETCH frames only, by an equi-join, so neither many
    regions nor long videos multiply; small sets of regions are sent to the frames.
    """
    stretch = lambda c: F.floor(F.col(c) / STRETCH)
    touched = regions.where("start_frame < end_frame").select(
        F.col("video_id").alias("_video"),
        F.explode(F.sequence(stretch("start_frame"), F.floor((F.col("end_frame") - 1) / STRETCH))).alias("_stretch"),
        "start_frame",
        "end_frame",
    )
    on = (
        (F.col("video_id") == F.col("_video"))
        & (stretch("frame_index") == F.col("_stretch"))
        & (F.col("frame_index") >= F.col("start_frame"))
        & (F.col("frame_index") < F.col("end_frame"))
    )
    return frames.join(touched, on, "left_semi")


def _masked(images: DataFrame, roi: tuple[float, float, float, float], kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Bit-packed masks that ``kernel`` makes of images (video_id, frame_index, h, w, image: BGR bytes), cropped to ``roi``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                pixels = np.frombuffer(row.image, dtype=np.uint8).reshape(row.h, row.w, 3)
                left, top, right, bottom = roi_bounds(roi, row.w, row.h)
                mask = kernel(pixels[top:bottom, left:right])
                rows.append((row.video_id, row.frame_index, *mask.shape, pack_mask(mask)))
            yield pd.DataFrame(rows, columns=["video_id", "frame_index", "h", "w", "edge"])

    return images.select("video_id", "frame_index", "h", "w", "image").mapInPandas(
        run, "video_id string, frame_index long, h int, w int, edge binary"
    )


def edge_frames(images: DataFrame, roi: tuple[float, float, float, float]) -> DataFrame:
    """Edge masks, for alignment."""
    return _masked(images, roi, canny)


#: Template mode looks at a fixed part of the frame.
TEMPLATE_ROI = (1 / 16, 29 / 36, 15 / 16, 8 / 9)


def binary_frames(images: DataFrame) -> DataFrame:
    """Opened adaptive binary masks of the fixed part, for template mode."""
    return _masked(images, TEMPLATE_ROI, lambda crop: open3(adaptive_binarise(crop)))


_recognisers: dict[object, Recogniser] = {}


def recognise(images: DataFrame, factory: Callable[[], Recogniser]) -> DataFrame:
    """Readings of images (video_id, frame_index, h, w, image); the recogniser is made once per worker, when needed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                model = _recognisers.get(factory) or _recognisers.setdefault(factory, factory())
                pixels = np.frombuffer(row.image, dtype=np.uint8).reshape(row.h, row.w, 3)
                for attempt, seen in enumerate([model.read(pixels), *model.alternatives(pixels)]):
                    if seen is not None:
                        box = dict(zip(("x0", "y0", "x1", "y1"), seen.box, strict=True))
                        rows.append((row.video_id, row.frame_index, attempt, seen.text, seen.confidence, box, seen.model))
            yield pd.DataFrame(
                rows, columns=["video_id", "frame_index", "attempt", "text", "confidence", "box", "model"]
            )

    return images.select("video_id", "frame_index", "h", "w", "image").mapInPandas(
        run,
        "video_id string, frame_index long, attempt int, text string, confidence double, "
        "box struct<x0: int, y0: int, x1: int, y1: int>, model string",
    )
