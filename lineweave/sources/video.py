"""Uncompressed video (YUV4MPEG2) as a table of frames, without a decoder library.

``spark.read.format("y4m").load(path)`` gives (video_id, frame_index, h, w, image): one row per frame, BGR bytes.  Frames
have a fixed size, so a task seeks to its frames and reads nothing else.  Options: ``video_id`` (the file's name without
its suffix unless given), ``roi`` (``left,top,right,bottom`` as fractions: only that part of a frame is passed on),
``start`` and ``end`` (frames; what lies outside is not read) and ``frames_per_task``.

Paths are those of files that every executor can open.  Defined results: a file that ends inside a frame ends before that
frame; an end beyond the file is its end; a file without frames gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.pixels import roi_bounds

MAGIC, FRAME = b"YUV4MPEG2", b"FRAME"
SCHEMA = "video_id string, frame_index long, h int, w int, image binary"
FRAMES_PER_TASK = 500
#: How much smaller the two colour planes are, across and down, by colour space; None: no such planes.
PLANES = {"420": (2, 2), "422": (2, 1), "444": (1, 1), "mono": None}


@dataclass(frozen=True)
class Header:
    """What a file says of all of its frames."""

    width: int
    height: int
    fps: Fraction
    colour: str
    #: Bytes before the first frame.
    offset: int

    @classmethod
    def read(cls, path: str) -> Header:
        with open(path, "rb") as stream:
            line = stream.readline()
        name, *tags = line.split()
        if name != MAGIC:
            raise ValueError(f"{path} is no YUV4MPEG2 file")
        found = {t[:1].decode(): t[1:].decode() for t in tags}
        colour = next((c for c in PLANES if found.get("C", "420").startswith(c)), None)
        if colour is None or "p1" in found.get("C", ""):
            raise ValueError(f"{path} has colours of a kind that is not known: {found['C']}")
        top, _, bottom = found.get("F", "25:1").partition(":")
        return cls(int(found["W"]), int(found["H"]), Fraction(int(top), int(bottom or 1)), colour, len(line))

    @property
    def plane(self) -> tuple[int, int]:
        """Height and width of a colour plane."""
        down = PLANES[self.colour]
        return (0, 0) if down is None else (-(-self.height // down[1]), -(-self.width // down[0]))

    @property
    def frame_bytes(self) -> int:
        return self.width * self.height + 2 * self.plane[0] * self.plane[1]

    def frames(self, path: str) -> int:
        return (Path(path).stat().st_size - self.offset) // (self.frame_bytes + len(FRAME) + 1)


def to_bgr(data: bytes, header: Header) -> np.ndarray:
    """One frame's pixels by the rule of BT.601 for studio levels."""
    h, w = header.height, header.width
    flat = np.frombuffer(data, dtype=np.uint8).astype(np.float64)
    luma = (flat[: h * w].reshape(h, w) - 16) * (255 / 219)
    if header.colour == "mono":
        return np.clip(np.rint(np.repeat(luma[..., None], 3, axis=2)), 0, 255).astype(np.uint8)
    ph, pw = header.plane
    across, down = PLANES[header.colour]
    u, v = (
        np.repeat(np.repeat(part.reshape(ph, pw), down, axis=0), across, axis=1)[:h, :w] - 128
        for part in np.split(flat[h * w :], 2)
    )
    scale = 255 / 224
    blue, green, red = (
        luma + 1.772 * scale * u,
        luma - (0.344136 * u + 0.714136 * v) * scale,
        luma + 1.402 * scale * v,
    )
    return np.clip(np.rint(np.stack([blue, green, red], axis=2)), 0, 255).astype(np.uint8)


@dataclass
class Stretch(InputPartition):
    start: int
    end: int


class VideoReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].removeprefix("file://")
        self.video_id = options.get("video_id") or Path(self.path).stem
        self.roi = tuple(float(x) for x in options["roi"].split(",")) if options.get("roi") else None
        self.start, self.end = int(options.get("start", 0)), options.get("end")
        self.step = int(options.get("frames_per_task", FRAMES_PER_TASK))
        self.header = Header.read(self.path)

    def partitions(self) -> list[InputPartition]:
        end = self.header.frames(self.path)
        if self.end is not None:
            end = min(end, int(self.end))
        return [Stretch(a, min(a + self.step, end)) for a in range(self.start, end, self.step)] or [Stretch(0, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        header = self.header
        size = header.frame_bytes + len(FRAME) + 1
        with open(self.path, "rb") as stream:
            stream.seek(header.offset + partition.start * size)
            for index in range(partition.start, partition.end):
                if stream.readline() != FRAME + b"\n":
                    raise ValueError(f"{self.path}: frame {index} has parameters of its own or is damaged")
                image = to_bgr(stream.read(header.frame_bytes), header)
                if self.roi is not None:
                    left, top, right, bottom = roi_bounds(self.roi, header.width, header.height)
                    image = image[top:bottom, left:right]
                yield self.video_id, index, image.shape[0], image.shape[1], image.tobytes()


class VideoSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return VideoReader(dict(self.options))


def register_video(spark: SparkSession) -> None:
    """Make the format ``y4m`` known to a session."""
    spark.dataSource.register(VideoSource)


def fps_text(path: str) -> str:
    """Frames per second as time formatting takes them: a decimal in its shortest form."""
    return repr(float(Header.read(path).fps)).removesuffix(".0")
