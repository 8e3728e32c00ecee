"""Interval algebra and window idioms against plain sequential Python."""

import random

import pytest
from pyspark.sql import functions as F

from lineweave.operators import intervals, readings, windows
from lineweave.operators.script_events import concat_parts
from lineweave.sinks.report import NothingMatched, report, require_matches

WINDOW = "video_id int, start_frame long, end_frame long, assets array<string>, bounds string"


def merge_plain(rows):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def subtract_plain(rows, known):
    covered = {f for s, e in known for f in range(s, e)}
    out = []
    for s, e in rows:
        for f in range(s, e):
            if f not in covered:
                if out and out[-1][1] == f and f != s and f - 1 not in covered:
                    out[-1][1] = f + 1
                else:
                    out.append([f, f + 1])
    return [tuple(x) for x in out]


def test_merge_and_subtract(spark):
    rng = random.Random(5)
    made, known = [], []
    for v in range(40):
        made += [(v, s, s + rng.randrange(1, 9)) for s in (rng.randrange(60) for _ in range(rng.randrange(1, 9)))]
        known += [(v, s, s + rng.randrange(1, 6)) for s in (rng.randrange(60) for _ in range(rng.randrange(0, 9)))]
    w = spark.createDataFrame([(*r, ["a"], "b") for r in made], WINDOW)
    k = spark.createDataFrame(known, "video_id int, start_frame long, end_frame long")
    merged = intervals.merge(w)
    left = intervals.subtract(merged, k)
    for df, plain in ((merged, lambda m, n: merge_plain(m)), (left, lambda m, n: subtract_plain(merge_plain(m), n))):
        got = {}
        for r in df.orderBy("video_id", "start_frame").collect():
            got.setdefault(r.video_id, []).append((r.start_frame, r.end_frame))
        for v in range(40):
            assert got.get(v, []) == plain([r[1:] for r in made if r[0] == v], [r[1:] for r in known if r[0] == v])


def test_touching_windows_merge_and_say_so(spark):
    w = spark.createDataFrame([(1, 0, 10, ["b"], "open_ended"), (1, 10, 20, ["a"], "open_ended"), (1, 25, 30, [], "manual")], WINDOW)
    got = [tuple(r) for r in intervals.merge(w).orderBy("start_frame").collect()]
    assert got == [(1, 0, 20, ["a", "b"], "merged"), (1, 25, 30, [], "manual")]
    k = spark.createDataFrame([(1, 3, 5), (1, 4, 8), (1, 18, 26)], "video_id int, start_frame long, end_frame long")
    left = [(r.start_frame, r.end_frame) for r in intervals.subtract(intervals.merge(w), k).orderBy("start_frame").collect()]
    assert left == [(0, 3), (8, 18), (26, 30)]


def test_reference_windows(spark):
    refs = spark.createDataFrame(
        [("v", "mv", 5, [0], [1], 0, 2), ("v", "end", 9, [0, 1], [], 0, 2), ("v", "second", 3, [], [], 2, 2)],
        "video_id string, asset string, line int, before array<int>, after array<int>, segment_start int, segment_end int",
    )
    results = spark.createDataFrame(
        [("v", 0, "matched", 10, 20), ("v", 1, "matched", 50, 60), ("v", 2, "unmatched", None, None)],
        "video_id string, idx int, status string, start_frame long, end_frame long",
    )
    videos = spark.createDataFrame([("v", 100)], "video_id string, total_frames long")
    got = {r.assets[0]: (r.start_frame, r.end_frame, r.bounds) for r in intervals.reference_windows(refs, results, videos).collect()}
    assert got == {
        "mv": (20, 50, "neighboring_dialogues"),
        "end": (60, 100, "open_ended"),
        "second": (60, 100, "open_ended"),
    }
    regions = intervals.scan_regions(
        intervals.reference_windows(refs, results, videos).unionByName(
            intervals.manual_windows(spark.createDataFrame([("v", 0, 15)], "video_id string, start_frame int, end_frame int"))
        ),
        results,
    )
    assert sorted((r.start_frame, r.end_frame) for r in regions.collect()) == [(0, 10), (20, 50), (60, 100)]


def frames(spark, hits):
    return spark.createDataFrame([(1, i, bool(h)) for i, h in enumerate(hits)], "v int, f long, hit boolean")


@pytest.mark.parametrize(
    ("hits", "end"), [([1, 1, 0, 0, 1, 0, 0, 0, 1], 5), ([1, 0, 0], 1), ([1, 1], 2), ([0, 0], 0), ([1, 0, 0, 0], 1)]
)
def test_hysteresis(spark, hits, end):
    assert windows.hysteresis_end(frames(spark, hits), 3, "v", "f").first().end == end


def test_throttle_and_confirmations(spark):
    rng = random.Random(9)
    times = sorted(rng.sample(range(1000), 200))
    df = spark.createDataFrame([(1, t) for t in times], "v int, us long")
    want, last = [], None
    for t in times:
        if last is None or t - last >= 37:
            want.append(t)
            last = t
    assert [r.us for r in windows.greedy_throttle(df, "us", 37, "v").orderBy("us").collect()] == want
    reads = [(1, i, t, rng.choice(["a", "b", None])) for i, t in enumerate(times)]
    df = spark.createDataFrame(reads, "v int, f long, us long, c string")
    want, run, old = [], 0, None
    for _, i, t, c in reads:
        run = run + 1 if old is not None and c is not None and c == old[1] and t - old[0] <= 8 else 1
        if c is not None and run == 2:
            want.append(i)
        old = (t, c)
    assert [r.f for r in windows.confirmations(df, 2, 8, "v", "f", "us", "c").orderBy("f").collect()] == want


def test_reading_order_and_boxes(spark):
    box = "struct<i: int, x: double, cy: double, h: double>"
    df = spark.createDataFrame([([(0, 50.0, 10.0, 8.0), (1, 5.0, 12.0, 8.0), (2, 0.0, 40.0, 8.0)],), ([],)], f"b array<{box}>")
    assert [r[0] for r in df.select(readings.reading_order(F.col("b"))).collect()] == [[1, 0, 2], []]
    text = spark.createDataFrame([("abcd", 0.9), (" ", 0.1)], "t string, c double")
    assert text.agg(readings.weighted_confidence(F.col("t"), F.col("c"))).first()[0] == pytest.approx(0.74)
    b = spark.createDataFrame([(1.5, 2.0, 30.2, 9.9), (4.0, 0.5, 99.0, 5.0)], "x0 double, y0 double, x1 double, y1 double")
    assert tuple(b.agg(readings.union_box("x0", "y0", "x1", "y1", 100, 20)).first()[0]) == (0, 0, 100, 13)


def test_attempts(spark):
    df = spark.createDataFrame([(1, 0, 100, "a", 0.9), (1, 1, 94, "b", 0.99), (1, 2, 96, "a", 0.9)], "k int, attempt int, width int, text_key string, confidence double")
    kept = readings.wide_enough(df, "k")
    assert sorted(r.attempt for r in kept.collect()) == [0, 2]
    best = readings.best_reading(kept, "k").first()
    assert (best.attempt, best.text_key, best.agreements) == (0, "a", 2)
    parts = spark.createDataFrame([(1, 0, 1, "b"), (1, 0, 0, "a"), (1, 1, 0, "c")], "k int, row int, place int, text string")
    assert readings.joined_text(parts, "k", True).first().text == "ab\nc"
    assert readings.joined_text(parts, "k", False).first().text == "abc"


def test_parts_are_numbered_on(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 0)], "recording int, part int, idx long")
    assert sorted((r.part, r.idx) for r in concat_parts(df).collect()) == [(0, 0), (0, 1), (1, 2)]


def test_report_leaves_out_what_is_missing(spark):
    import json

    results = spark.createDataFrame([("v", 0, "matched", None), ("v", 1, "unmatched", "why")], "video_id string, idx int, status string, reason string")
    videos = spark.createDataFrame([("v", "30", 9)], "video_id string, fps string, total_frames long")
    found = spark.createDataFrame([], "video_id string, text string")
    data = json.loads(report(results, found, videos, {"lookahead": "5"}).first().report)
    assert data["stats"] == {"matched": 1, "unmatched": 1}
    assert data["events"] == [{"idx": 0, "status": "matched"}, {"idx": 1, "status": "unmatched", "reason": "why"}]
    assert "movie_events" not in data
    require_matches(results, found)
    with pytest.raises(NothingMatched):
        require_matches(results.where("idx = 1"), found)


def onset_plain(hits, anchor, k):
    """Walk back from the anchor over the frames up to it."""
    start, misses = anchor, 0
    for f in sorted((f for f in hits if f <= anchor), reverse=True):
        if hits[f]:
            start, misses = f, 0
        else:
            misses += 1
            if misses >= k:
                break
    return start


@pytest.mark.parametrize("k", [1, 2, 3])
def test_onsets_against_a_walk(spark, k):
    rng = random.Random(k)
    frames, anchors, want = [], [], set()
    for v in range(30):
        hits = {f: rng.random() < 0.5 for f in range(0, 40) if rng.random() < 0.9}
        frames += [(v, f, h) for f, h in hits.items()]
        for a in sorted({rng.randrange(45) for _ in range(12)}):  # some on no frame, some behind the last
            anchors.append((v, a))
            want.add((v, a, onset_plain(hits, a, k)))
    got = windows.backward_onset(
        spark.createDataFrame(frames, "v int, f long, hit boolean").repartition(3), spark.createDataFrame(anchors, "v int, anchor long"), k, "v", "f"
    ).collect()
    assert {tuple(r) for r in got} == want
    assert len(got) == len(want)


def test_throttle_over_batches_and_keys(spark):
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(5)}", rng.randrange(10_000)) for _ in range(3000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {tuple(r) for r in windows.greedy_throttle(spark.createDataFrame(rows, "k string, us long"), "us", 100, "k").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = set()
    for key in {k for k, _ in rows}:
        last = None
        for t in sorted(t for k, t in rows if k == key):
            if last is None or t - last >= 100:
                want.add((key, t))
                last = t
    assert got == want


def test_barriers(spark):
    rng = random.Random(3)
    readings_ = [(rng.randrange(4), rng.randrange(20), i) for i in range(200)] + [(9, 3, 200)]
    gaps = [(k, b) for k in range(4) for b in rng.sample(range(20), 4)]
    from lineweave.operators.match import with_barrier

    got = with_barrier(
        spark.createDataFrame(readings_, "k int, cursor int, n int"), spark.createDataFrame(gaps, "k int, before_idx int"), "k"
    ).collect()
    want = {n: min((b for g, b in gaps if g == k and b > c), default=None) for k, c, n in readings_}
    assert {r.n: r.limit for r in got} == want
    assert len(got) == len(readings_)


def test_ranged_frames_over_stretches(spark, monkeypatch):
    from lineweave.sources import frames as scans

    monkeypatch.setattr(scans, "STRETCH", 16)
    rng = random.Random(4)
    frames = [(v, f) for v in "ab" for f in range(300)]
    regions = [(v, s, s + rng.randrange(0, 60)) for v in "ab" for s in (rng.randrange(280) for _ in range(6))]
    got = scans.ranged_frames(
        spark.createDataFrame(frames, "video_id string, frame_index long"),
        spark.createDataFrame(regions, "video_id string, start_frame long, end_frame long"),
    ).collect()
    want = {(v, f) for v, f in frames if any(v == w and s <= f < e for w, s, e in regions)}
    assert {tuple(r) for r in got} == want
    assert len(got) == len(want)


def test_subtract_keeps_what_windows_carry(spark):
    w = spark.createDataFrame([(1, 0, 10, ["a"], "x"), (1, 10, 14, ["b"], None), (2, 5, 9, None, "y")], WINDOW)
    k = spark.createDataFrame([(1, 2, 3), (1, 2, 5), (1, 12, 12), (3, 0, 9)], "video_id int, start_frame long, end_frame long")
    got = sorted(intervals.subtract(w, k).collect(), key=lambda r: (r.video_id, r.start_frame))
    assert [(r.video_id, r.start_frame, r.end_frame, r.assets, r.bounds) for r in got] == [
        (1, 0, 2, ["a"], "x"), (1, 5, 10, ["a"], "x"), (1, 10, 12, ["b"], None), (1, 12, 14, ["b"], None), (2, 5, 9, None, "y"),
    ]
