"""Evidence reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NothingMatched(RuntimeError):
    """No event was matched or found; the report has been written all the same."""


def report(
    results: DataFrame,
    found: DataFrame,
    videos: DataFrame,
    options: dict[str, str],
    counted: DataFrame | None = None,
    found_counted: DataFrame | None = None,
    elapsed_seconds: float | None = None,
) -> DataFrame:
    """(video_id, report): one JSON document per recording; values that are missing are left out.

    ``counted`` and ``found_counted`` (video_id, stats) are what the machines counted.
    """
    body = F.struct(*[c for c in results.columns if c != "video_id"])
    events = results.groupBy("video_id").agg(
        F.array_sort(F.collect_list(body)).alias("events"),
        F.count_if(F.col("status") == "matched").alias("matched"),
        F.count_if(F.col("status") != "matched").alias("unmatched"),
    )
    row = F.struct(*[c for c in found.columns if c != "video_id"])
    extra = found.groupBy("video_id").agg(F.array_sort(F.collect_list(row)).alias("movie_events"))
    pairs = F.create_map(*[F.lit(x) for kv in sorted(options.items()) for x in kv]) if options else F.create_map()
    joined = videos.join(events, "video_id", "left").join(extra, "video_id", "left")
    no_counts = F.lit(None).cast("map<string, bigint>")
    for table, name in ((counted, "counted"), (found_counted, "movie_stats")):
        if table is None:
            joined = joined.withColumn(name, no_counts)
        else:
            joined = joined.join(table.withColumnRenamed("stats", name), "video_id", "left")
    told = ("frames", "ocr_calls", "peak_buffer_frames", "peak_buffer_bytes")
    stats = F.struct(
        F.coalesce("matched", F.lit(0)).alias("matched"),
        F.coalesce("unmatched", F.lit(0)).alias("unmatched"),
        *[F.try_element_at("counted", F.lit(name)).alias(name) for name in told],
        F.lit(elapsed_seconds).cast("double").alias("elapsed_seconds"),
    )
    return joined.select(
        "video_id",
        F.to_json(
            F.struct(
                F.col("video_id").alias("video"),
                "fps",
                F.col("total_frames").alias("video_frames"),
                pairs.alias("options"),
                stats.alias("stats"),
                "events",
                "movie_events",
                "movie_stats",
            )
        ).alias("report"),
    )


def require_matches(results: DataFrame, found: DataFrame) -> None:
    """Raise if nothing at all was matched or found; call it after the report is written."""
    if results.where("status = 'matched'").isEmpty() and found.isEmpty():
        raise NothingMatched("no event was matched")
