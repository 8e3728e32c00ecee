"""Queries of time arithmetic, ordered output and checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefmt import frame_to_seconds, frame_to_time, seconds_to_time
from ..sinks.ass import dialogue_lines, in_output_order
from ..sources.check_table import INFO_ID, verify_source
from .registry import query
from .surrogates import FRAMES_SQL, frames, table

FILM, VIDEO = "23.976023976023978", "29.97002997002997"


def format_sql(cs: str) -> str:
    return (
        f"CAST(({cs}) // 360000 AS VARCHAR) || ':' || lpad(CAST(({cs}) % 360000 // 6000 AS VARCHAR), 2, '0') || ':' || "
        f"lpad(CAST(({cs}) % 6000 // 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(({cs}) % 100 AS VARCHAR), 2, '0')"
    )


def frame_sql(frame: str, fps: str) -> str:
    whole, _, digits = fps.partition(".")
    return f"(CAST({frame} AS HUGEINT) * 100 * {10 ** len(digits)} // {whole}{digits})"


@query(f"SELECT event_id, {format_sql('c')} AS at FROM (SELECT event_id, greatest(0, CAST(round_even(value * 100, 0) AS BIGINT)) AS c FROM events)")
def seconds_to_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", seconds_to_time(F.col("value")).alias("at"))


@query(
    f"""SELECT o_orderkey, {format_sql("a")} AS film, {format_sql("b")} AS video, round(o_orderkey / {FILM}, 6) AS seconds
    FROM (SELECT o_orderkey, {frame_sql("o_orderkey", FILM)} AS a, {frame_sql("o_orderkey", VIDEO)} AS b FROM orders)"""
)
def frame_to_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        frame_to_time(key, FILM).alias("film"),
        frame_to_time(key, VIDEO).alias("video"),
        F.round(frame_to_seconds(key, FILM), 6).alias("seconds"),
    )


@query("SELECT doc_id, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS ok, sha256(text) AS sha256 FROM documents")
def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files and a check table of their digests, where every fifth is wrong and every seventh missing."""
    documents = table(spark, sf_dir, "documents")
    files = documents.select(F.col("doc_id").cast("string").alias("script_id"), F.encode("text", "UTF-8").alias("content"))
    check = documents.where("doc_id % 7 <> 0").select(
        F.lit(INFO_ID).alias("id"),
        F.col("doc_id").cast("string").alias("name"),
        F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("text"),
    )
    return verify_source(check, files).select(F.col("script_id").cast("long").alias("doc_id"), "ok", F.col("actual").alias("sha256"))


@query(
    f"""WITH {FRAMES_SQL}, u AS (
        SELECT user_id, event_id, f AS start_frame, f + 1 + event_id % 15 AS end_frame,
               CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS src, event_type AS name
        FROM frames WHERE event_type IN ('view', 'error'))
    SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start_frame // 4, src, event_id) AS INTEGER) AS place,
        'Dialogue: 0,' || {format_sql(frame_sql("start_frame", "30"))} || ',' || {format_sql(frame_sql("end_frame", "30"))}
        || ',Style,' || CASE WHEN src = 1 THEN 'OCR' ELSE name END || ',0,0,0,,' AS line FROM u"""
)
def union_ordered_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = frames(spark, sf_dir).select(
        F.col("user_id").alias("video_id"),
        F.col("f").alias("start_frame"),
        (F.col("f") + 1 + F.col("event_id") % 15).alias("end_frame"),
        F.col("event_id").alias("seq"),
        "event_type",
        F.lit("Style").alias("style"),
        F.lit("").alias("text"),
        # ties by coarse time, so that the source decides
        F.floor(F.col("f") / 4).alias("order_frame"),
    )
    scripted = base.where("event_type = 'view'").withColumn("name", F.col("event_type"))
    found = base.where("event_type = 'error'")
    ordered = in_output_order(scripted, found, order="order_frame")
    return dialogue_lines(ordered, "30", comments=False).select(F.col("video_id").alias("user_id"), "place", "line")
