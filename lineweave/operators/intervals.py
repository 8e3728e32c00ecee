"""Interval algebra over half-open frame ranges, per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(windows: DataFrame, key: str = "video_id") -> DataFrame:
    """Union of intervals (start_frame, end_frame, assets, bounds); those that touch become one.

    Assets are united; an interval made of several has bounds ``merged``.
    """
    in_order = Window.partitionBy(key).orderBy("start_frame", "end_frame")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end_frame").over(before)
    marked = windows.withColumn("fresh", F.when(F.col("start_frame") <= reach, 0).otherwise(1))
    island = F.sum("fresh").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        marked.withColumn("island", island)
        .groupBy(key, "island")
        .agg(
            F.min("start_frame").alias("start_frame"),
            F.max("end_frame").alias("end_frame"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("assets")))).alias("assets"),
            F.when(F.count("*") > 1, "merged").otherwise(F.first("bounds")).alias("bounds"),
        )
        .drop("island")
    )


def subtract(windows: DataFrame, known: DataFrame, key: str = "video_id") -> DataFrame:
    """What of disjoint ``windows`` no ``known`` interval covers; known intervals may overlap each other.

    One sweep over the end points of a key: where a window is open and no known interval is, a piece reaches to the
    next end point.
    """
    names = [c for c in windows.columns if c not in (key, "start_frame", "end_frame")]
    zero, one = F.lit(0), F.lit(1)
    row = F.struct(*names) if names else F.struct(F.lit(0).alias("_"))
    none = F.lit(None).cast(windows.select(row.alias("r")).schema["r"].dataType)

    def points(intervals: DataFrame, open_: Column, covered: Column, first: Column) -> DataFrame:
        ends = F.explode(
            F.array(
                F.struct(F.col("start_frame").alias("at"), open_.alias("open"), covered.alias("covered"), first.alias("row")),
                F.struct(F.col("end_frame").alias("at"), (-open_).alias("open"), (-covered).alias("covered"), none.alias("row")),
            )
        )
        return intervals.select(key, ends.alias("e")).select(key, "e.*")

    along = Window.partitionBy(key).orderBy("at")
    here = along.rangeBetween(Window.unboundedPreceding, 0)  # end points at one place count together
    swept = points(windows, one, zero, row).unionByName(points(known, zero, one, none)).select(
        key,
        F.col("at").alias("start_frame"),
        F.lead("at").over(along).alias("end_frame"),
        F.sum("open").over(here).alias("open"),
        F.sum("covered").over(here).alias("covered"),
        F.last("row", ignorenulls=True).over(here).alias("row"),
    )
    left = swept.where("open > 0 AND covered = 0 AND start_frame < end_frame")
    return left.select("*", "row.*").select(windows.columns)


def reference_windows(refs: DataFrame, results: DataFrame, videos: DataFrame) -> DataFrame:
    """The frames in which each reference (video_id, asset, before, after, segment_start, segment_end) may play.

    From the last end of the matched events before it to the first start of those after it; events of other
    parts bound a part without matches of its own, the ends of the recording (``videos``: total_frames) the rest.
    """
    matched = results.where("status = 'matched'").select("video_id", "idx", "start_frame", "end_frame")
    joined = refs.withColumn("ref", F.xxhash64("video_id", "asset", "line")).alias("r").join(
        matched.alias("m"), "video_id", "left"
    )
    before = F.array_contains("before", F.col("idx")) | (F.col("idx") < F.col("segment_start"))
    after = F.array_contains("after", F.col("idx")) | (F.col("idx") >= F.col("segment_end"))
    bounds = joined.groupBy("video_id", "ref", "asset").agg(
        F.max(F.when(before, F.col("end_frame"))).alias("low"), F.min(F.when(after, F.col("start_frame"))).alias("high")
    )
    return (
        bounds.join(videos.select("video_id", "total_frames"), "video_id")
        .select(
            "video_id",
            F.coalesce("low", F.lit(0)).cast("long").alias("start_frame"),
            F.coalesce("high", "total_frames").cast("long").alias("end_frame"),
            F.array("asset").alias("assets"),
            F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), "neighboring_dialogues")
            .otherwise("open_ended")
            .alias("bounds"),
        )
        .where("start_frame < end_frame")
    )


def manual_windows(ranges: DataFrame) -> DataFrame:
    """Ranges (video_id, start_frame, end_frame) given by hand; they take the place of references."""
    return ranges.select(
        "video_id",
        F.col("start_frame").cast("long").alias("start_frame"),
        F.col("end_frame").cast("long").alias("end_frame"),
        F.array().cast("array<string>").alias("assets"),
        F.lit("manual").alias("bounds"),
    )


def scan_regions(windows: DataFrame, results: DataFrame) -> DataFrame:
    """Merged windows without the frames of matched events."""
    return subtract(merge(windows), results.where("status = 'matched'"))
