import glob
import json

import numpy as np
import pytest

from lineweave.__main__ import arguments, main
from lineweave.functions.layout import glyph_kind, layout, template_parts
from lineweave.functions.pixels import matches_template
from lineweave.functions.registry import register
from lineweave.sources.frames import Reading, binary_frames, edge_frames, recognise

from .scenes import BOX, H, W, frame, glyphs

SCRIPT = r"""[title title=Demo]
[message text=hello there world name=Ann clip=\{"_startTime":1.0,"_duration":2.5\}]
[video video=mv_01 clip=\{"_startTime":4.0,"_duration":3.0\}]
[narration text=good morning all clip=\{"_startTime":9.0,"_duration":1\}]
"""


def test_align_and_convert(spark, tmp_path):
    (tmp_path / "demo.txt").write_text(SCRIPT, encoding="utf-8")
    shows = [(5, 25, 1, "hello there world"), (40, 60, 2, "A song {of} old"), (70, 90, 3, "good morning all")]
    frames, readings = [], []
    for i in range(110):
        on = next((s for s in shows if s[0] <= i < s[1]), None)
        frames.append(("v", i, H, W, frame(i, glyphs(on[2]) if on else None).edge))
        if on:
            readings.append(("v", i, 0, on[3], 0.9, BOX, "m"))
    box = "struct<x0: int, y0: int, x1: int, y1: int>"
    spark.createDataFrame(frames, "video_id string, frame_index long, h int, w int, edge binary").write.parquet(str(tmp_path / "f"))
    spark.createDataFrame(
        readings, f"video_id string, frame_index long, attempt int, text string, confidence double, box {box}, model string"
    ).write.parquet(str(tmp_path / "r"))
    out = str(tmp_path / "out")
    main(["align", "--script", str(tmp_path / "demo.txt"), "--output", out, "--frames", str(tmp_path / "f"), "--readings",
          str(tmp_path / "r"), "--video-id", "v", "--fps", "10", "--no-comments"])
    text = open(glob.glob(f"{out}/video_id=v/part-*")[0], encoding="utf-8").read()
    assert [line for line in text.splitlines() if line.startswith("Dialogue")] == [
        "Dialogue: 0,0:00:00.50,0:00:02.50,IdolyPride Normal,Ann,0,0,0,,hello there world",
        "Dialogue: 0,0:00:04.00,0:00:06.00,IdolyPride Normal,OCR,0,0,0,,A song ｛of｝ old",
        "Dialogue: 0,0:00:07.00,0:00:09.00,IdolyPride Gray,,0,0,0,,good morning all",
    ]
    assert text.startswith("﻿[Script Info]")
    data = json.loads(open(glob.glob(f"{out}.review/part-*")[0], encoding="utf-8").read())
    assert data["stats"]["elapsed_seconds"] > 0
    assert data["stats"]["frames"] > 0
    assert (data["stats"]["matched"], data["stats"]["unmatched"]) == (2, 0)
    assert data["movie_stats"]["ocr_calls"] > 0
    assert [e["movie_assets"] for e in data["movie_events"]] == [["mv_01"]]
    assert glob.glob(f"{out}.movies/video_id=v/part-*")
    main(["convert", "--script", str(tmp_path / "demo.txt"), "--output", f"{out}2"])
    assert glob.glob(f"{out}2/video_id=demo.txt/part-*")


def test_arguments_are_checked():
    base = ["align", "--script", "s", "--output", "o", "--frames", "f", "--readings", "r", "--video-id", "v", "--fps", "30"]
    assert arguments([*base, "--range", "5:9"]).range == [(5, 9)]
    for bad in (["--range", "9:5"], ["--gap-seconds", "-1"], ["--captions", "off", "--range", "1:2"]):
        with pytest.raises(SystemExit):
            arguments([*base, *bad])


def test_sql_names(spark):
    register(spark)
    assert spark.sql("SELECT nfkc('ｱ'), text_normalize('ｧ!'), text_key('a b')").first()[:] == ("ア", "ア", "ab")
    rows = spark.sql("SELECT f.* FROM VALUES ('[message text=a name=b]') AS t(l), LATERAL parse_fields(l) AS f").collect()
    assert [(r.key, r.source) for r in rows] == [("text", "a"), ("name", "b")]


class Fake:
    def read(self, image):
        return Reading("seen", 0.5, (0, 0, 3, 3), "fake") if image.any() else None

    def alternatives(self, image):
        return iter([Reading("again", 0.4, (0, 0, 3, 3), "fake")])


def test_images_to_masks_and_readings(spark):
    image = np.zeros((72, 96, 3), dtype=np.uint8)
    image[60:63, 30:60] = 255
    rows = [("v", 0, 72, 96, image.tobytes()), ("v", 1, 72, 96, bytes(72 * 96 * 3))]
    df = spark.createDataFrame(rows, "video_id string, frame_index long, h int, w int, image binary")
    edges = edge_frames(df, (0.0, 0.0, 1.0, 1.0)).orderBy("frame_index").collect()
    assert [(r.h, r.w, any(r.edge)) for r in edges] == [(72, 96, True), (72, 96, False)]
    fixed = binary_frames(df).orderBy("frame_index").collect()
    assert [(r.h, r.w) for r in fixed] == [(6, 84)] * 2
    seen = recognise(df, Fake).orderBy("frame_index", "attempt").collect()
    assert [(r.frame_index, r.attempt, r.text) for r in seen] == [(0, 0, "seen"), (0, 1, "again"), (1, 1, "again")]


def test_layout_of_lines():
    assert [glyph_kind(c) for c in "aア1!é"] == ["alpha", "japan", "digit", "alpha", "japan"]
    plan = layout("a" * 16, lambda kind, c: (4, 9))
    assert (plan.width, plan.height, plan.cut) == (16 * 5 - 1, 9, 40)
    assert layout("ab", lambda kind, c: (4, 9)).cut is None
    rng = np.random.default_rng(3)
    shapes = {c: (rng.random((9, 8)) > 0.4).astype(np.uint8) * 200 for c in "xyz"}
    parts = template_parts("xyz", lambda kind, c: (8, 9), lambda kind, c: shapes[c])
    canvas = np.zeros((20, 60), dtype=np.uint8)
    canvas[5:14, 7:33] = parts[0][0]
    assert matches_template(canvas, [(parts[0][0], np.ones_like(parts[0][1]))])
