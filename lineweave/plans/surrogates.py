"""Deterministic stand-ins, from the sample tables, for scripts, frames, readings and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import ASCII, LATIN, ascii_match_form
from ..session import ship

HIT = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as frames: f numbers them by time, us is microseconds since the first, hit is value >= 30."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    user = Window.partitionBy("user_id")
    return table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        "event_type",
        "value",
        (F.row_number().over(user.orderBy("ts", "event_id")) - 1).cast("long").alias("f"),
        (micros - F.min(micros).over(user)).alias("us"),
        F.coalesce(F.col("value") >= HIT, F.lit(False)).alias("hit"),
    )


FRAMES_SQL = f"""frames AS (
    SELECT user_id, event_id, event_type, value,
           CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS f,
           epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS us,
           coalesce(value >= {HIT}, false) AS hit
    FROM events
)"""


def intervals(frame: DataFrame, event_type: str, modulus: int) -> DataFrame:
    """(video_id, start_frame, end_frame, asset) from the frames of one event type."""
    return frame.where(F.col("event_type") == event_type).select(
        F.col("user_id").alias("video_id"),
        F.col("f").alias("start_frame"),
        (F.col("f") + 1 + F.col("event_id") % modulus).alias("end_frame"),
        F.concat(F.lit("a"), (F.col("event_id") % 5).cast("string")).alias("asset"),
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(frames(spark, sf_dir), "view", 15).select(
        "video_id", "start_frame", "end_frame", F.array("asset").alias("assets"), F.lit("neighboring_dialogues").alias("bounds")
    )


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(frames(spark, sf_dir), "error", 8).select("video_id", "start_frame", "end_frame")


WINDOWS_SQL = """w AS (
    SELECT user_id AS video_id, f AS start_frame, f + 1 + event_id % 15 AS end_frame,
           'a' || CAST(event_id % 5 AS VARCHAR) AS asset
    FROM frames WHERE event_type = 'view'
), k AS (
    SELECT user_id AS video_id, f AS start_frame, f + 1 + event_id % 8 AS end_frame
    FROM frames WHERE event_type = 'error'
), wm AS (
    SELECT *, CASE WHEN start_frame <= max(end_frame) OVER (
        PARTITION BY video_id ORDER BY start_frame, end_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
    ) THEN 0 ELSE 1 END AS fresh FROM w
), wi AS (
    SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY start_frame, end_frame ROWS UNBOUNDED PRECEDING) AS island FROM wm
), merged AS (
    SELECT video_id, min(start_frame) AS start_frame, max(end_frame) AS end_frame,
           string_agg(DISTINCT asset, ',' ORDER BY asset) AS assets,
           CASE WHEN count(*) > 1 THEN 'merged' ELSE 'neighboring_dialogues' END AS bounds
    FROM wi GROUP BY video_id, island
)"""


def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, idx, text): turns of a conversation as script lines in matching form."""
    return (
        table(spark, sf_dir, "conversations")
        .select("conv_id", F.col("turn").alias("idx"), ascii_match_form(F.col("text")).alias("text"))
        .where("text <> ''")
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three noisy readings of every script line: one character is replaced, confidence and frame grow."""
    lines = script(spark, sf_dir).withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    at = (F.lit(1) + (7 * F.col("conv_id") + 3 * F.col("idx") + F.col("rep")) % F.length("text")).cast("int")
    noisy = F.concat(
        F.substring(F.col("text"), F.lit(1), at - 1), F.lit("x"), F.substring(F.col("text"), at + 1, F.length("text"))
    )
    return lines.select(
        "conv_id",
        F.col("idx").alias("turn"),
        "rep",
        (90 * F.col("idx") + 12 + 6 * F.col("rep")).alias("frame"),
        (F.lit(70) + 5 * F.col("rep")).alias("confidence_pct"),
        F.greatest(F.lit(0).cast("long"), F.col("idx") - 1).alias("cursor"),
        noisy.alias("text"),
    )


SCRIPT_SQL = f"""script AS (
    SELECT conv_id, turn AS idx, lower(regexp_replace(translate(
        replace(replace(text, '\\N', ''), '\\n', ''), '{LATIN}', '{ASCII}'), '[^A-Za-z0-9]', '', 'g')) AS text
    FROM conversations
), lines AS (SELECT * FROM script WHERE text <> ''),
readings AS (
    SELECT conv_id, idx AS turn, rep, 90 * idx + 12 + 6 * rep AS frame, 70 + 5 * rep AS confidence_pct,
           greatest(0, idx - 1) AS cursor,
           substr(text, 1, CAST((7 * conv_id + 3 * idx + rep) % length(text) AS INTEGER)) || 'x' ||
           substr(text, 2 + CAST((7 * conv_id + 3 * idx + rep) % length(text) AS INTEGER)) AS text
    FROM lines, (SELECT unnest([0, 1, 2])::BIGINT AS rep)
), scored AS (
    SELECT r.conv_id, r.turn, r.rep, r.frame, r.confidence_pct, r.cursor, r.text, l.idx, l.text AS line_text,
           1 - CAST(levenshtein(r.text, l.text) AS DOUBLE) / greatest(length(r.text), length(l.text)) AS score
    FROM readings r JOIN lines l ON l.conv_id = r.conv_id AND l.idx >= r.cursor AND l.idx < r.cursor + 5
), best AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn, rep ORDER BY score DESC, idx) AS n,
           first_value(line_text) OVER (PARTITION BY conv_id, turn, rep ORDER BY score DESC, idx) AS best_text
    FROM scored
), others AS (
    SELECT conv_id, turn, rep, max(score) FILTER (WHERE line_text <> best_text) AS other FROM best GROUP BY ALL
), chosen AS (
    SELECT b.* FROM best b JOIN others o USING (conv_id, turn, rep)
    WHERE n = 1 AND score >= 0.8 AND (least(length(text), length(line_text)) > 4 OR text = line_text)
      AND (other IS NULL OR score - other >= 0.08)
)"""
