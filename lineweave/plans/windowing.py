"""Queries of intervals, window idioms and aggregates over readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import mask_change
from ..operators.intervals import merge, reference_windows, subtract
from ..operators.intervals import scan_regions as regions_of
from ..operators.readings import best_reading, reading_order as order_of, union_box as box_of, weighted_confidence as mean_of
from ..operators.script_events import neighbours
from ..operators.windows import (
    backward_onset,
    buffer_size,
    confirmations as confirmed,
    episodes,
    greedy_throttle as throttled,
    hysteresis_end as end_of,
    previous,
    stable_run as stable,
)
from .registry import query
from .surrogates import FRAMES_SQL, WINDOWS_SQL, frames, intervals, known, table, windows

def _assets() -> Column:
    return F.array_join("assets", ",").alias("assets")


@query(f"WITH {FRAMES_SQL}, {WINDOWS_SQL} SELECT video_id, start_frame, end_frame, assets, bounds FROM merged")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge(windows(spark, sf_dir)).select("video_id", "start_frame", "end_frame", _assets(), "bounds")


_DIFFERENCE = """cut AS (
    SELECT m.video_id, m.start_frame AS lo, m.end_frame AS hi, m.assets, m.bounds, k.start_frame AS ks, k.end_frame AS ke
    FROM merged m LEFT JOIN k ON k.video_id = m.video_id AND k.end_frame > m.start_frame AND k.start_frame < m.end_frame
), gaps AS (
    SELECT video_id, greatest(lo, coalesce(max(ke) OVER (PARTITION BY video_id, lo ORDER BY ks, ke
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo)) AS start_frame, ks AS end_frame, assets, bounds
    FROM cut WHERE ks IS NOT NULL
    UNION ALL
    SELECT video_id, greatest(lo, coalesce(max(ke), lo)), hi, assets, bounds FROM cut GROUP BY video_id, lo, hi, assets, bounds
)"""


@query(
    f"""WITH {FRAMES_SQL}, {WINDOWS_SQL}, {_DIFFERENCE}
    SELECT video_id, start_frame, end_frame FROM gaps WHERE start_frame < end_frame"""
)
def interval_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtract(merge(windows(spark, sf_dir)), known(spark, sf_dir)).select("video_id", "start_frame", "end_frame")


@query(
    f"""WITH {FRAMES_SQL}, {WINDOWS_SQL}, {_DIFFERENCE}
    SELECT video_id, start_frame, end_frame, assets, bounds FROM gaps WHERE start_frame < end_frame"""
)
def scan_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = known(spark, sf_dir).withColumn("status", F.lit("matched"))
    return regions_of(windows(spark, sf_dir), results).select("video_id", "start_frame", "end_frame", _assets(), "bounds")


@query(
    f"""WITH {FRAMES_SQL}, {WINDOWS_SQL}, {_DIFFERENCE}
    SELECT f.user_id, f.f FROM frames f
    WHERE EXISTS (SELECT 1 FROM gaps g WHERE g.video_id = f.user_id AND g.start_frame < g.end_frame
                  AND f.f >= g.start_frame AND f.f < g.end_frame)"""
)
def ranged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.frames import ranged_frames

    every = frames(spark, sf_dir).select(F.col("user_id").alias("video_id"), F.col("f").alias("frame_index"))
    regions = subtract(merge(windows(spark, sf_dir)), known(spark, sf_dir))
    return ranged_frames(every, regions).select(F.col("video_id").alias("user_id"), F.col("frame_index").alias("f"))


@query(
    f"""WITH {FRAMES_SQL}, {WINDOWS_SQL}
    SELECT w.video_id, w.start_frame, w.asset,
        count(CASE WHEN k.end_frame <= w.start_frame + 0.1 THEN 1 END) AS before,
        count(CASE WHEN k.start_frame >= w.end_frame - 0.1 THEN 1 END) AS after
    FROM w LEFT JOIN k ON k.video_id = w.video_id GROUP BY ALL"""
)
def before_after_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(*_references(spark, sf_dir)).select(
        F.col("script_id").alias("video_id"),
        F.col("line").alias("start_frame"),
        "asset",
        F.size("before").cast("long").alias("before"),
        F.size("after").cast("long").alias("after"),
    )


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Windows as references of scripts, and known intervals as their events."""
    frame = frames(spark, sf_dir)
    refs = intervals(frame, "view", 15).select(
        F.col("video_id").alias("script_id"),
        F.col("start_frame").alias("line"),
        "asset",
        F.col("start_frame").cast("double").alias("script_start"),
        (F.col("end_frame") - F.col("start_frame")).cast("double").alias("script_duration"),
    )
    events = known(spark, sf_dir).select(
        F.col("video_id").alias("script_id"),
        F.col("start_frame").alias("idx"),
        F.col("start_frame").cast("double").alias("start_s"),
        (F.col("end_frame") - F.col("start_frame")).cast("double").alias("duration_s"),
    )
    return refs, events


@query(
    f"""WITH {FRAMES_SQL}, {WINDOWS_SQL}, n AS (SELECT user_id, max(f) + 1 AS total FROM frames GROUP BY user_id),
    b AS (SELECT w.video_id, w.start_frame AS line, w.asset,
            max(CASE WHEN k.end_frame <= w.start_frame + 0.1 THEN k.end_frame END) AS low,
            min(CASE WHEN k.start_frame >= w.end_frame - 0.1 THEN k.start_frame END) AS high
        FROM w LEFT JOIN k ON k.video_id = w.video_id GROUP BY w.video_id, w.start_frame, w.asset)
    SELECT video_id, asset, coalesce(low, 0) AS start_frame, coalesce(high, total) AS end_frame,
        CASE WHEN low IS NULL OR high IS NULL THEN 'open_ended' ELSE 'neighboring_dialogues' END AS bounds
    FROM b JOIN n ON n.user_id = b.video_id WHERE coalesce(low, 0) < coalesce(high, total)"""
)
def default_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where references may play, between the matched events around them or the ends of the recording."""
    refs, events = _references(spark, sf_dir)
    matched = known(spark, sf_dir).select("video_id", F.col("start_frame").alias("idx"), F.lit("matched").alias("status"), "start_frame", "end_frame")
    videos = frames(spark, sf_dir).groupBy(F.col("user_id").alias("video_id")).agg((F.max("f") + 1).alias("total_frames"))
    placed = neighbours(refs, events).withColumnRenamed("script_id", "video_id").withColumns(
        {"segment_start": F.lit(0).cast("long"), "segment_end": F.lit(1 << 40)}
    )
    found = reference_windows(placed, matched, videos)
    return found.select("video_id", F.col("assets")[0].alias("asset"), "start_frame", "end_frame", "bounds")


_MASK = "(event_id * 2654435761 % 4294967296)"


@query(
    f"""WITH {FRAMES_SQL}, m AS (SELECT user_id, f, {_MASK} AS mask FROM frames),
    p AS (SELECT *, lag(mask) OVER (PARTITION BY user_id ORDER BY f) AS old FROM m)
    SELECT user_id, f, round(CASE WHEN old IS NULL THEN 1.0::DOUBLE
        ELSE bit_count(xor(mask, old))::DOUBLE / greatest(bit_count(mask | old), 1) END, 6) AS changed FROM p"""
)
def change_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of 4 x 8 pixels, bit-packed."""
    bits = F.unhex(F.lpad(F.hex(F.expr(_MASK)), 8, "0"))
    masks = frames(spark, sf_dir).select("user_id", "f", bits.alias("mask"))
    masks = masks.withColumn("old", previous("mask", "user_id", "f"))
    return masks.select("user_id", "f", F.round(mask_change("old", "mask", F.lit(4), F.lit(8)), 6).alias("changed"))


@query(
    f"""WITH {FRAMES_SQL}, i AS (SELECT user_id, f, hit,
        sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY f ROWS UNBOUNDED PRECEDING) AS island FROM frames)
    SELECT user_id, f, row_number() OVER (PARTITION BY user_id, island ORDER BY f) - CASE WHEN island = 0 THEN 0 ELSE 1 END AS stable
    FROM i"""
)
def stable_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable(frames(spark, sf_dir), F.col("hit"), "user_id", "f").select(
        "user_id", "f", F.col("stable").cast("long").alias("stable")
    )


@query(
    f"""WITH {FRAMES_SQL}, a AS (SELECT user_id, f, hit,
        sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY f ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS misses
        FROM frames)
    SELECT user_id, coalesce(min(CASE WHEN misses = 3 THEN f END), max(CASE WHEN hit THEN f END) + 1, min(f)) AS "end"
    FROM a GROUP BY user_id"""
)
def hysteresis_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return end_of(frames(spark, sf_dir), 3, "user_id", "f")


@query(
    f"""WITH {FRAMES_SQL}, h AS (SELECT user_id, f, CASE WHEN f - lag(f) OVER (PARTITION BY user_id ORDER BY f) > 3 THEN 1 ELSE 0 END AS fresh
        FROM frames WHERE hit), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY f ROWS UNBOUNDED PRECEDING) AS run FROM h)
    SELECT user_id, min(f) AS "first", max(f) AS "last", count(*) AS hits FROM r GROUP BY user_id, run"""
)
def hit_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes(frames(spark, sf_dir), 3, "user_id", "f")


@query(
    f"""WITH {FRAMES_SQL}, b AS (SELECT user_id, least(count(*) OVER (PARTITION BY user_id ORDER BY us
        RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), 6) AS held FROM frames)
    SELECT user_id, max(held) AS peak, count(*) AS frames FROM b GROUP BY user_id"""
)
def time_buffer_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = buffer_size(frames(spark, sf_dir), "us", 86_400_000_000, 6, "user_id")
    return held.groupBy("user_id").agg(F.max("held").alias("peak"), F.count("*").alias("frames"))


@query(
    f"""WITH RECURSIVE {FRAMES_SQL}, acts AS (
        SELECT user_id, min(us) AS us FROM frames GROUP BY user_id
        UNION ALL
        SELECT user_id, us FROM (SELECT a.user_id, min(f.us) AS us FROM acts a JOIN frames f
            ON f.user_id = a.user_id AND f.us >= a.us + 172800000000 GROUP BY a.user_id, a.us))
    SELECT user_id, us FROM acts"""
)
def greedy_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttled(frames(spark, sf_dir), "us", 172_800_000_000, "user_id")


@query(
    f"""WITH {FRAMES_SQL}, c AS (SELECT user_id, f, us, event_id, CASE WHEN hit THEN event_type END AS candidate FROM frames),
    p AS (SELECT *, CASE WHEN candidate = lag(candidate) OVER w AND us - lag(us) OVER w <= 259200000000 THEN 0 ELSE 1 END AS fresh
        FROM c WINDOW w AS (PARTITION BY user_id ORDER BY f)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY f ROWS UNBOUNDED PRECEDING) AS run FROM p),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY f) AS place FROM r)
    SELECT user_id, f, candidate FROM n WHERE place = 2 AND candidate IS NOT NULL"""
)
def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = frames(spark, sf_dir).withColumn("candidate", F.when(F.col("hit"), F.col("event_type")))
    return confirmed(read, 2, 259_200_000_000, "user_id", "f", "us", "candidate").select("user_id", "f", "candidate")


@query(
    f"""WITH {FRAMES_SQL}, a AS (SELECT user_id, f AS anchor FROM frames WHERE event_type = 'purchase'),
    w AS (SELECT a.user_id, a.anchor, f.f, f.hit,
            sum(CASE WHEN f.hit THEN 0 ELSE 1 END) OVER (PARTITION BY a.user_id, a.anchor ORDER BY f.f DESC ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run,
            row_number() OVER (PARTITION BY a.user_id, a.anchor ORDER BY f.f DESC) AS n
        FROM a JOIN frames f ON f.user_id = a.user_id AND f.f <= a.anchor),
    s AS (SELECT *, max(CASE WHEN run = 3 AND n >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, anchor ORDER BY n ROWS UNBOUNDED PRECEDING) AS stopped FROM w)
    SELECT user_id, anchor, coalesce(min(CASE WHEN stopped = 0 AND hit THEN f END), anchor) AS onset FROM s GROUP BY user_id, anchor"""
)
def onset_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = frames(spark, sf_dir)
    anchors = every.where("event_type = 'purchase'").select("user_id", F.col("f").alias("anchor"))
    return backward_onset(every, anchors, 3, "user_id", "f")


@query(
    """SELECT source, round(sum(w * (doc_id % 31 + 1) / 32.0::DOUBLE) / sum(w), 6) AS confidence FROM (
        SELECT source, doc_id, CAST(greatest(1, length(trim(text))) AS DOUBLE) AS w FROM documents) GROUP BY source"""
)
def weighted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = mean_of(F.col("text"), (F.col("doc_id") % 31 + 1) / F.lit(32.0))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(mean, 6).alias("confidence"))


@query(
    """SELECT label, greatest(0, CAST(floor(min(x0)) AS INTEGER) - 2) AS x0, greatest(0, CAST(floor(min(y0)) AS INTEGER) - 2) AS y0,
        least(640, CAST(ceil(max(x1)) AS INTEGER) + 3) AS x1, least(90, CAST(ceil(max(y1)) AS INTEGER) + 3) AS y1 FROM (
        SELECT label, abs(embedding[i]::DOUBLE) * 300 AS x0, abs(embedding[i + 1]::DOUBLE) * 60 AS y0,
            abs(embedding[i]::DOUBLE) * 300 + 40 AS x1, abs(embedding[i + 1]::DOUBLE) * 60 + 30 AS y1
        FROM (SELECT label, embedding, unnest(range(1, len(embedding), 2)) AS i FROM embeddings)) GROUP BY label"""
)
def union_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.explode(F.sequence(F.lit(0), F.size("embedding") - 2, F.lit(2)))
    x, y = (F.abs(F.get("embedding", F.col("i") + k).cast("double")) * n for k, n in ((0, 300), (1, 60)))
    boxes = table(spark, sf_dir, "embeddings").select("label", "embedding", place.alias("i")).select(
        "label", x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 30).alias("y1")
    )
    return boxes.groupBy("label").agg(box_of("x0", "y0", "x1", "y1", 640, 90).alias("b")).select("label", "b.*")


@query(
    """WITH a AS (SELECT doc_id // 4 AS grp, doc_id % 4 AS attempt, length(text) % 3 AS text_key, n_chars % 17 AS confidence FROM documents),
    b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY confidence DESC, attempt) AS n,
        first_value(text_key) OVER (PARTITION BY grp ORDER BY confidence DESC, attempt) AS best FROM a)
    SELECT grp, min(CASE WHEN n = 1 THEN attempt END) AS attempt, any_value(best) AS text_key, max(confidence) AS confidence,
        count(CASE WHEN text_key = best THEN 1 END) AS agreements FROM b GROUP BY grp"""
)
def best_reading_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 4).alias("grp"),
        (F.col("doc_id") % 4).alias("attempt"),
        (F.length("text") % 3).cast("long").alias("text_key"),
        (F.col("n_chars") % 17).alias("confidence"),
    )
    return best_reading(attempts, "grp")


@query(
    """WITH RECURSIVE b AS (
        SELECT vec_id, i, abs(embedding[4 * i + 1]::DOUBLE) * 300 AS x, abs(embedding[4 * i + 2]::DOUBLE) * 60 AS cy,
            greatest(1.0, abs(embedding[4 * i + 4]::DOUBLE) * 30) AS h
        FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 4)) AS i FROM embeddings)
    ), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cy, i) AS n FROM b
    ), walk AS (
        SELECT vec_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(c DOUBLE, h DOUBLE)[]) AS rows, CAST([] AS BIGINT[]) AS homes FROM embeddings
        UNION ALL
        SELECT vec_id, n, CASE WHEN home > len(rows) THEN list_append(rows, {'c': cy, 'h': h}) ELSE rows END, list_append(homes, home)
        FROM (SELECT w.vec_id, o.n, w.rows, w.homes, o.cy, o.h,
                coalesce(list_position(list_transform(w.rows, lambda r: abs(o.cy - r.c) <= least(o.h, r.h) * 0.5), true), len(w.rows) + 1) AS home
            FROM walk w JOIN o ON o.vec_id = w.vec_id AND o.n = w.n + 1)
    ), done AS (SELECT w.vec_id, unnest(w.homes) AS home, unnest(range(1, len(w.homes) + 1)) AS n
        FROM walk w JOIN embeddings e ON e.vec_id = w.vec_id WHERE w.n = len(e.embedding) // 4)
    SELECT d.vec_id, string_agg(CAST(o.i AS VARCHAR), ',' ORDER BY d.home, o.x, o.cy, o.i) AS places
    FROM done d JOIN o ON o.vec_id = d.vec_id AND o.n = d.n GROUP BY d.vec_id"""
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda i: F.abs(F.get(F.col("embedding"), i).cast("double"))
    boxes = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("embedding") / 4).cast("int") - 1),
        lambda i: F.struct(
            i.alias("i"), (cell(4 * i) * 300).alias("x"), (cell(4 * i + 1) * 60).alias("cy"), (cell(4 * i + 3) * 30).alias("h")
        ),
    )
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.array_join(F.transform(order_of(boxes), lambda i: i.cast("string")), ",").alias("places")
    )
