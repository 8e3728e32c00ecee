import json
import random

import numpy as np
import pytest

from lineweave.config import Options, supplement_options
from lineweave.streaming.captions import CaptionExtractor, Region
from lineweave.streaming.lines import NO_MATCH, SKIPPED, LineAligner, choose
from lineweave.streaming.run import CAPTIONS, RESULTS, caption_machine, frame_rows, line_machine, run_batch, run_stream
from lineweave.streaming.templates import NotFound, Placed, place_lines

from .scenes import BOX, FPS, H, W, frame, glyphs, play

LINES = ["hello there world", "good morning all", "what a fine day", "see you tomorrow"]


def aligner(lines=LINES, durations=None, gaps=None, **options):
    return LineAligner([(t, (durations or {}).get(i, 2.0)) for i, t in enumerate(lines)], FPS, Options(**options), gaps)


def times(rows):
    return [(r.get("start_frame"), r.get("end_frame"), r.get("end_reason")) for r in rows]


def test_choice_of_lines():
    o = Options()
    lines = ["hellothereworld", "hellothereworld", "goodmorningall", "abcd"]
    assert choose("hellothereworld", lines, 0, 4, o) == (0, 1.0)
    assert choose("helothereworld", lines, 0, 4, o) == (0, 1 - 1 / 15)
    assert choose("abce", lines, 0, 4, o) is None
    assert choose("", lines, 0, 4, o) is None
    assert choose("hellothereworld", lines, 0, 0, o) is None
    assert choose("kittensatonmat", ["kittensatonmat", "kittensatonamat"], 0, 2, o) is None
    assert choose("redlamp", ["redlamp", "redlamps"], 0, 2, o) == (0, 1.0)


def test_lines_with_pauses_have_exact_times():
    rows = play(aligner(LINES[:2]), 80, [(5, 25, 1, LINES[0]), (40, 60, 2, LINES[1])])
    assert times(rows) == [(5, 25, "visual_change"), (40, 60, "visual_change")]
    assert rows[0]["text_similarity"] == 1.0
    assert "reason" not in rows[0]


def test_lines_back_to_back():
    rows = play(aligner(LINES[:2]), 60, [(5, 25, 1, LINES[0]), (25, 45, 2, LINES[1])])
    assert times(rows)[0][:2] == (5, 25)
    assert times(rows)[1][:2] == (25, 45)


def test_a_line_that_is_not_recorded_is_skipped():
    rows = play(aligner(), 100, [(5, 25, 1, LINES[0]), (40, 60, 3, LINES[2])])
    assert rows[1]["status"] == "unmatched"
    assert rows[1]["reason"] == SKIPPED
    assert rows[3]["reason"] == NO_MATCH
    assert rows[2]["start_frame"] == 40


def test_a_line_twice_in_a_row_is_placed_in_order():
    rows = play(aligner(["same old song"] * 2), 80, [(5, 25, 1, "same old song"), (40, 60, 1, "same old song")])
    assert [r["start_frame"] for r in rows] == [5, 40]


def test_a_single_reading_is_not_enough():
    rows = play(aligner(), 60, [(10, 11, 1, LINES[0])])
    assert all(r["status"] == "unmatched" for r in rows)


def test_a_short_line_may_be_read_once():
    shows = [(10, 14, 1, LINES[0], {"confidence": 0.99})]
    quick = {"ocr_interval": 0.3, "recheck_interval": 1.0}
    assert play(aligner(durations={0: 0.5}, **quick), 40, shows)[0]["status"] == "matched"
    assert play(aligner(durations={0: 2.0}, **quick), 40, shows)[0]["status"] == "unmatched"


@pytest.mark.parametrize(("blank", "end"), [(2, 40), (3, 20)])
def test_short_flicker_does_not_end_a_line(blank, end):
    shows = [(5, 20, 1, LINES[0]), (20 + blank, 40, 1, None)]
    rows = play(aligner(), 60, shows)
    assert rows[0]["end_frame"] == end


def test_an_onset_beyond_the_buffer_is_flagged():
    shows = [(5, 45, 1, "???"), (45, 60, 1, LINES[0])]
    row = play(aligner(buffer_seconds=1.0), 80, shows)[0]
    assert row["onset_buffer_limited"] is True
    assert row["start_frame"] > 5


def test_a_gap_is_passed_over_once_and_bars_matching_across_it():
    shows = [(5, 25, 1, LINES[0]), (30, 45, 2, LINES[1]), (70, 90, 3, LINES[1])]
    rows = play(aligner(LINES[:2], gaps={1: 3.0}), 110, shows)
    assert times(rows) == [(5, 25, "visual_change"), (70, 90, "visual_change")]
    early = play(aligner(LINES[:2], gaps={1: 3.0}), 60, [(5, 25, 2, LINES[1])])
    assert early[1]["status"] == "unmatched"


def test_more_unread_lines_than_the_lookahead_stall():
    lines = [f"line number {'abcdefgh'[i] * 6}" for i in range(8)]
    rows = play(aligner(lines, lookahead=3), 60, [(5, 25, 1, lines[5])])
    assert all(r["status"] == "unmatched" for r in rows)


def test_the_end_of_the_input_ends_a_line():
    assert times(play(aligner(), 30, [(5, 30, 1, LINES[0])]))[0] == (5, 30, "video_end")
    assert times(play(aligner(), 27, [(5, 25, 1, LINES[0])]))[0] == (5, 25, "video_end")


def test_alternatives_are_tried_in_order_after_a_reading_fails():
    machine = aligner()
    rows = play(machine, 40, [(5, 25, 1, "garbage", {"others": [("junk", 0.99), (LINES[0], 0.9), (LINES[1], 0.9)]})])
    assert rows[0]["ocr_model"] == "alt"
    assert rows[1]["status"] == "unmatched"
    silent = play(aligner(), 40, [(5, 25, 1, None, {"others": [(LINES[0], 0.9)]})])
    assert silent[0]["status"] == "unmatched"


def test_moving_all_frames_moves_all_times():
    shows = [(5, 25, 1, LINES[0]), (25, 45, 2, LINES[1]), (60, 75, 4, LINES[3])]
    a = play(aligner(), 100, shows)
    b = play(aligner(), 130, [(s + 30, e + 30, *rest) for s, e, *rest in shows])
    assert [(s + 30, e + 30) for s, e, _ in times(a) if s is not None] == [(s, e) for s, e, _ in times(b) if s is not None]


def extractor(regions=((0, 200),), **options):
    base = supplement_options(Options())
    return CaptionExtractor([Region(a, b, ("mv",)) for a, b in regions], FPS, Options(**{**vars(base), **options}))


def test_captions_are_found_without_a_script():
    rows = play(extractor(), 80, [(5, 25, 1, "Hello you"), (40, 60, 2, "Bye now")])
    assert [(r["text"], r["start_frame"], r["end_frame"]) for r in rows] == [("Hello you", 5, 25), ("Bye now", 40, 60)]
    assert rows[0]["needs_review"] is True
    assert rows[0]["observations"] >= 2


def test_a_revised_spelling_over_the_same_glyphs_is_absorbed():
    machine = extractor()
    shows = [(5, 15, 1, "Hel1o you", {"confidence": 0.9}), (15, 35, 1, "Hello you", {"confidence": 0.97})]
    rows = play(machine, 60, shows)
    assert [(r["text"], r["start_frame"], r["end_frame"]) for r in rows] == [("Hello you", 5, 35)]


def test_a_region_ends_what_is_open():
    rows = play(extractor(((0, 20), (20, 60))), 60, [(5, 40, 1, "Hello you")])
    assert [(r["start_frame"], r["end_frame"], r["end_reason"]) for r in rows] == [
        (5, 20, "region_end"),
        (20, 40, "visual_change"),
    ]
    assert play(extractor(((30, 60),)), 60, [(5, 20, 1, "Hello you")]) == []


def test_unusable_readings_are_counted():
    machine = extractor()
    assert play(machine, 40, [(5, 25, 1, "!?"), (25, 35, 2, "12")]) == []
    assert machine.stats["rejected_readings"] > 0


def test_confident_but_cut_retries_are_not_preferred():
    machine = extractor()
    first = frame(0, glyphs(1), "Hello you", 0.9)
    first.attempts.append(first.attempts[0].__class__("Hello", 0.99, (0, 0, 20, H), "alt"))
    assert machine._recognise(first)[0].text == "Hello you"


def test_template_mode():
    hits = [[1, 1, 0, 0, 1, 0, 0, 0, 1, 0], [0, 0, 0, 0, 0, 0, 1, 1, 0, 0]]
    shown = lambda line, f: bool(hits[line][f])
    assert list(place_lines(shown, 2, 10)) == [Placed(0, 0, 5), Placed(1, 6, 10)]
    with pytest.raises(NotFound):
        list(place_lines(lambda line, f: False, 1, 5))
    assert list(place_lines(lambda line, f: False, 1, 5, strict=False)) == []
    assert list(place_lines(lambda line, f: True, 1, 9, gaps={0: 2})) == [Placed(0, 2, 9)]


def _tables(spark, videos):
    frames, readings, meta = [], [], []
    for v in range(videos):
        shows = [(5 + v, 25, v + 1, LINES[0]), (40, 60, v + 9, LINES[1])]
        for i in range(80):
            on = next((s for s in shows if s[0] <= i < s[1]), None)
            f = frame(i, glyphs(on[2]) if on else None)
            frames.append((f"v{v}", i, H, W, f.edge))
            if on:
                readings.append((f"v{v}", i, 0, on[3], 0.9, BOX, "m"))
        lines = [{"text": t, "duration": 2.0} for t in LINES]
        meta.append((f"v{v}", json.dumps({"fps": "10", "lines": lines, "regions": [{"start_frame": 0, "end_frame": 80}]})))
    random.Random(1).shuffle(frames)
    box = "struct<x0: int, y0: int, x1: int, y1: int>"
    return (
        spark.createDataFrame(frames, "video_id string, frame_index long, h int, w int, edge binary").repartition(7),
        spark.createDataFrame(readings, f"video_id string, frame_index long, attempt int, text string, confidence double, box {box}, model string"),
        spark.createDataFrame(meta, "video_id string, meta string"),
    )


def test_recordings_do_not_mix_whatever_the_partitioning(spark):
    rows = frame_rows(*_tables(spark, 5))
    got = run_batch(rows, line_machine(Options()), RESULTS).where("status = 'matched'").orderBy("video_id", "idx").collect()
    assert [(r.video_id, r.idx, r.start_frame, r.end_frame) for r in got] == [
        (f"v{v}", i, s, e) for v in range(5) for i, s, e in ((0, 5 + v, 25), (1, 40, 60))
    ]
    found = run_batch(rows, caption_machine(supplement_options(Options())), CAPTIONS).orderBy("video_id", "start_frame").collect()
    assert [(r.video_id, r.start_frame, r.text) for r in found][:2] == [("v0", 5, LINES[0]), ("v0", 40, LINES[1])]


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    rows = frame_rows(*_tables(spark, 3))
    ends = rows.groupBy("video_id").agg({"frame_index": "max"}).selectExpr("video_id", "`max(frame_index)` + 1 AS frame_index")
    closing = ends.selectExpr(
        "video_id", "frame_index", "CAST(NULL AS STRING) AS meta", "CAST(NULL AS INT) AS h", "CAST(NULL AS INT) AS w",
        "CAST(NULL AS BINARY) AS edge", "CAST(NULL AS " + rows.schema["attempts"].dataType.simpleString() + ") AS attempts", "true AS last",
    )
    rows.unionByName(closing, allowMissingColumns=True).repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run_stream(source, line_machine(Options()), RESULTS)
    query = (
        out.writeStream.format("memory").queryName("aligned").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    columns = ["video_id", "idx", "status", "start_frame", "end_frame", "end_reason"]
    batch = run_batch(rows, line_machine(Options()), RESULTS)
    assert sorted(map(str, spark.table("aligned").select(columns).collect())) == sorted(map(str, batch.select(columns).collect()))


def placed_plain(shown, lines, frames, k, gaps):
    """Line after line, each looked for from where the one before it ended."""
    out, cursor = [], 0
    for line in range(lines):
        cursor += gaps.get(line, 0)
        start = next((f for f in range(cursor, frames) if shown[line][f]), None)
        if start is None:
            return out
        end = frames
        for f in range(start + k, frames):
            if not any(shown[line][f - k + 1 : f + 1]):
                end = f - k + 1
                break
        out.append(Placed(line, start, end))
        cursor = end
    return out


def test_lines_are_placed_as_by_looking_again(spark):
    rng = np.random.default_rng(1)
    for _ in range(300):
        k, frames = int(rng.integers(1, 5)), int(rng.integers(1, 60))
        shown = rng.random((5, frames)) < rng.choice([0.2, 0.5, 0.8])
        gaps = {int(i): int(rng.integers(0, 6)) for i in rng.integers(0, 5, 2)}
        want = placed_plain(shown.tolist(), 5, frames, k, gaps)
        assert list(place_lines(lambda line, f: shown[line][f], 5, frames, k, gaps, strict=False)) == want


def test_statistics_and_glyph_masks_come_through(spark):
    from lineweave.config import supplement_options
    from lineweave.streaming.run import align, captions, split_statistics

    frames, readings, meta = _tables(spark, 2)
    plain = align(frames, readings, meta).collect()
    results, counted = split_statistics(align(frames, readings, meta, with_stats=True).cache())
    assert sorted(map(str, results.collect())) == sorted(map(str, plain))
    stats = {r.video_id: r.stats for r in counted.collect()}
    assert len(stats) == 2
    assert all(s["frames"] > 0 and s["ocr_calls"] > 0 and s["peak_buffer_bytes"] >= s["peak_buffer_frames"] > 0 for s in stats.values())
    # a recording without any result still says what was counted
    found, counted = split_statistics(captions(frames, readings.limit(0), meta, supplement_options(Options()), with_stats=True))
    assert found.count() == 0
    assert {r.video_id for r in counted.collect()} == set(stats)
    rows = frame_rows(frames.withColumn("glyphs", frames["edge"]), readings, meta).where("frame_index = 3").collect()
    assert rows
    assert all(r.glyphs == r.edge for r in rows)
