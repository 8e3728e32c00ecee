"""State machines over many recordings: in batch, and as a stateful stream.

Both read rows of one layout (ROWS): a recording's ``meta`` row (frame -1, JSON: fps, lines, gaps or regions),
its frames, and for streams a closing row (``last``).  In batch a task streams through its recordings in
order, so that it holds one recording's state and never its frames.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import Options
from .captions import CaptionExtractor, Region
from .frames import Frame, Seen
from .lines import LineAligner

BOX = "struct<x0: int, y0: int, x1: int, y1: int>"
ATTEMPT = f"struct<attempt: int, text: string, confidence: double, box: {BOX}, model: string>"
ROWS = f"video_id string, frame_index long, meta string, h int, w int, edge binary, glyphs binary, attempts array<{ATTEMPT}>, last boolean"
RESULTS = (
    "video_id string, idx int, text string, status string, reason string, start_frame long, start double, end_frame long, "
    "`end` double, end_reason string, ocr_text string, ocr_model string, ocr_confidence double, text_similarity double, "
    "onset_buffer_limited boolean"
)
CAPTIONS = (
    "video_id string, status string, source string, needs_review boolean, text string, start_frame long, start double, "
    "end_frame long, `end` double, end_reason string, ocr_confidence double, ocr_model string, observations int, "
    "onset_buffer_limited boolean, movie_assets array<string>, ocr_box array<int>"
)


class Machine(Protocol):
    fps: float
    stats: dict[str, int]

    def feed(self, frame: Frame) -> None: ...

    def close(self) -> list[dict]: ...


def line_machine(options: Options) -> Callable[[dict], Machine]:
    def make(meta: dict) -> Machine:
        lines = [(line["text"], line.get("duration") or 0.0) for line in meta.get("lines") or []]
        gaps = {int(i): float(s) for i, s in (meta.get("gaps") or {}).items()}
        return LineAligner(lines, float(meta["fps"]), options, gaps)

    return make


def caption_machine(options: Options) -> Callable[[dict], Machine]:
    def make(meta: dict) -> Machine:
        regions = [Region(r["start_frame"], r["end_frame"], tuple(r.get("assets") or ())) for r in meta.get("regions") or []]
        return CaptionExtractor(sorted(regions, key=lambda r: r.start_frame), float(meta["fps"]), options)

    return make


def seen_of(attempts) -> list[Seen | None]:
    """Attempts by their numbers, None where one is missing."""
    seen: list[Seen | None] = []
    for a in attempts if attempts is not None else []:
        box = a["box"]
        seen.extend([None] * (a["attempt"] - len(seen)))
        seen.append(Seen(a["text"], a["confidence"], (box["x0"], box["y0"], box["x1"], box["y1"]), a["model"] or ""))
    return seen


def frame_of(row, fps: float) -> Frame:
    glyphs = getattr(row, "glyphs", None)
    glyphs = None if glyphs is None else bytes(glyphs)
    return Frame(int(row.frame_index), row.frame_index / fps, int(row.h), int(row.w), bytes(row.edge), seen_of(row.attempts), glyphs)


def frame_rows(frames: DataFrame, readings: DataFrame, meta: DataFrame) -> DataFrame:
    """ROWS from frames (video_id, frame_index, h, w, edge, glyphs?), readings (…, attempt, text, confidence, box, model)
    and meta (video_id, meta)."""
    if "glyphs" not in frames.columns:
        frames = frames.withColumn("glyphs", F.lit(None).cast("binary"))
    attempts = readings.groupBy("video_id", "frame_index").agg(
        F.array_sort(F.collect_list(F.struct("attempt", "text", "confidence", "box", "model"))).alias("attempts")
    )
    none = F.lit(None)
    shown = frames.join(attempts, ["video_id", "frame_index"], "left").select(
        "video_id", "frame_index", none.cast("string").alias("meta"), "h", "w", "edge", "glyphs", "attempts", F.lit(False).alias("last")
    )
    head = meta.select(
        "video_id",
        F.lit(-1).cast("long").alias("frame_index"),
        "meta",
        none.cast("int").alias("h"),
        none.cast("int").alias("w"),
        none.cast("binary").alias("edge"),
        none.cast("binary").alias("glyphs"),
        none.cast(f"array<{ATTEMPT}>").alias("attempts"),
        F.lit(False).alias("last"),
    )
    return head.unionByName(shown)


#: What a recording's machine counted, on the first row of its results (a row of its own if there are none).
STATISTICS = "stats map<string, bigint>"


def _table(video_id: str, rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([{**dict.fromkeys(names), **row, "video_id": video_id} for row in rows], columns=names).astype(object)


#: Frames whose masks are unpacked at once; a mask may have 100,000 pixels and more, a byte each.
BLOCK = 64


def unpacked_masks(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    """The edge masks of a batch, those of one size in one go; None where there is none."""
    masks: list[np.ndarray | None] = [None] * batch.num_rows
    edges = batch.column("edge").to_pylist()
    by_size: dict[tuple[int, int], list[int]] = {}
    for i, size in enumerate(zip(batch.column("h").to_pylist(), batch.column("w").to_pylist(), strict=True)):
        if edges[i] is not None:
            by_size.setdefault(size, []).append(i)
    for (h, w), places in by_size.items():
        raw = np.frombuffer(b"".join(edges[i] for i in places), dtype=np.uint8).reshape(len(places), -1)
        bits = np.unpackbits(raw, axis=1, count=h * w).view(bool).reshape(-1, h, w)
        for i, mask in zip(places, bits, strict=True):
            masks[i] = mask
    return masks


def run_batch(rows: DataFrame, make: Callable[[dict], Machine], schema: str, with_stats: bool = False) -> DataFrame:
    """Every recording's frames through a machine of its own, in order of frames; ``with_stats`` adds STATISTICS.

    Masks are unpacked BLOCK at a time, and readings become objects on the frames where the machine may ask for them."""
    if with_stats:
        schema = f"{schema}, {STATISTICS}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def results(video: str, machine: Machine) -> pa.RecordBatch:
        found = [{**row, "video_id": video} for row in machine.close()]
        if with_stats:
            first, *rest = found or [{"video_id": video}]
            found = [{**first, "stats": list(machine.stats.items())}, *rest]
        return pa.RecordBatch.from_pylist(found, schema=arrow)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, machine = None, None
        for batch in (batch.slice(at, BLOCK) for batch in batches for at in range(0, batch.num_rows, BLOCK)):
            masks = unpacked_masks(batch)
            names = ("video_id", "frame_index", "meta", "h", "w", "edge", "glyphs", "attempts")
            columns = (batch.column(n).to_pylist() for n in names)
            for mask, here, index, meta, h, w, edge, glyphs, attempts in zip(masks, *columns, strict=True):
                if here != video:
                    if machine is not None:
                        yield results(video, machine)
                    video, machine = here, None
                if meta is not None:
                    machine = make(json.loads(meta))
                elif machine is not None:
                    machine.feed(Frame(index, index / machine.fps, h, w, edge, seen_of(attempts), glyphs, mask))
        if machine is not None:
            yield results(video, machine)

    ordered = rows.repartition("video_id").sortWithinPartitions("video_id", "frame_index")
    return ordered.mapInArrow(stream, schema)


def run_stream(rows: DataFrame, make: Callable[[dict], Machine], schema: str) -> DataFrame:
    """The same over a stream of ROWS: frames that come early wait until those before them are there.

    Frames of a recording are numbered 0, 1, 2 … without holes; the row with ``last`` (its frame_index is one past
    the last frame) ends it and emits its results.
    """
    names = [c.strip("` ").split("`")[0].split(" ")[0] for c in schema.split(", ")]

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        machine, due, waiting = pickle.loads(state.get[0]) if state.exists else (None, -1, {})
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.frame_index >= due:
                    waiting[int(row.frame_index)] = row._asdict()
        while due in waiting:
            row = pd.Series(waiting.pop(due))
            due += 1
            if isinstance(row["meta"], str):
                machine = make(json.loads(row["meta"]))
            elif row["last"]:
                state.remove()
                yield _table(key[0], machine.close(), names)
                return
            else:
                machine.feed(frame_of(row, machine.fps))
        state.update((pickle.dumps((machine, due, waiting)),))

    return rows.groupBy("video_id").applyInPandasWithState(update, schema, "state binary", "append", "NoTimeout")


def align(
    frames: DataFrame, readings: DataFrame, meta: DataFrame, options: Options | None = None, with_stats: bool = False
) -> DataFrame:
    """Times of script lines: one row of RESULTS per line of every recording."""
    return run_batch(frame_rows(frames, readings, meta), line_machine(options or Options()), RESULTS, with_stats)


def captions(frames: DataFrame, readings: DataFrame, meta: DataFrame, options: Options, with_stats: bool = False) -> DataFrame:
    """Captions inside the regions of every recording, as rows of CAPTIONS."""
    return run_batch(frame_rows(frames, readings, meta), caption_machine(options), CAPTIONS, with_stats)


def split_statistics(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results without their statistics, and the statistics (video_id, stats) of each recording."""
    counted = results.where("stats IS NOT NULL").select("video_id", "stats")
    return results.where("status IS NOT NULL").drop("stats"), counted
