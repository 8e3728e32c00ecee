"""Command line: scripts to subtitle documents, and recordings (tables of frames and readings) to aligned ones."""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Options, frame_range, gap_seconds, read_ini, supplement_options
from .operators.intervals import manual_windows, merge, reference_windows, scan_regions
from .operators.script_events import load_events, script_events
from .session import ship
from .sinks.ass import dialogue_lines, document, in_output_order, script_document, write_documents
from .sinks.report import report, require_matches
from .sources.scripts import script_files, script_lines
from .streaming.run import align, captions, split_statistics

LOG = logging.getLogger("lineweave")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="lineweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    convert = commands.add_parser("convert", help="subtitle documents by the scripts' own times")
    recorded = commands.add_parser("align", help="times of script lines in recordings")
    for command in (convert, recorded):
        command.add_argument("--script", required=True, help="script file, or folder of .txt files")
        command.add_argument("--output", required=True)
        command.add_argument("--player-name", default="")
    recorded.add_argument("--second-script", help="second part of the script")
    recorded.add_argument("--gap-seconds", type=lambda s: gap_seconds(float(s)), default=0.0)
    recorded.add_argument("--frames", required=True, help="table of frames (video_id, frame_index, h, w, edge)")
    recorded.add_argument("--readings", required=True)
    recorded.add_argument("--video-id", required=True)
    recorded.add_argument("--fps", required=True)
    recorded.add_argument("--config", help="INI file with [Hybrid] and [Movie OCR] sections")
    recorded.add_argument("--captions", choices=("auto", "off", "all"), default="auto")
    recorded.add_argument("--range", action="append", default=[], type=frame_range, metavar="START:END")
    recorded.add_argument("--no-comments", action="store_true")
    given = parser.parse_args(argv)
    if given.command == "align" and given.captions == "off" and given.range:
        parser.error("--range cannot be used with --captions off")
    return given


def run_convert(spark: SparkSession, given: argparse.Namespace) -> None:
    events = script_events(script_lines(script_files(spark, given.script)), given.player_name)
    write_documents(script_document(events).withColumnRenamed("script_id", "video_id"), given.output)


def run_align(spark: SparkSession, given: argparse.Namespace) -> None:
    sections = read_ini(given.config) if given.config else {}
    options = Options.read(sections.get("Hybrid", {}))
    one = F.lit(given.video_id)
    parts = [
        script_lines(script_files(spark, path)).withColumn("script_id", one)
        for path in (given.script, given.second_script)
        if path
    ]
    events, refs, gaps = load_events(parts, given.gap_seconds, given.player_name)
    frames = spark.read.parquet(given.frames).where(F.col("video_id") == given.video_id)
    readings = spark.read.parquet(given.readings).where(F.col("video_id") == given.video_id)
    videos = frames.groupBy("video_id").agg((F.max("frame_index") + 1).alias("total_frames"), F.lit(given.fps).alias("fps"))
    said = F.array_sort(F.collect_list(F.struct("idx", "text", F.col("duration_s").alias("duration"))))
    pauses = gaps.groupBy("script_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("before_idx").cast("string"), "seconds"))).alias("gaps"))
    meta = (
        events.groupBy("script_id").agg(said.alias("lines")).join(pauses, "script_id", "left")
        .select(F.col("script_id").alias("video_id"), F.to_json(F.struct(F.lit(given.fps).alias("fps"), "lines", "gaps")).alias("meta"))
    )
    begun = time.monotonic()
    results, counted = split_statistics(align(frames, readings, meta, options, with_stats=True).cache())
    found_counted = None
    if given.captions == "off":
        found = captions(frames, readings, meta, options).limit(0)
    else:
        if given.range or given.captions == "all":
            ranges = given.range or [(0, videos.first().total_frames)]
            windows = manual_windows(
                spark.createDataFrame([(given.video_id, *r) for r in ranges], "video_id string, start_frame long, end_frame long")
            )
        else:
            windows = reference_windows(refs.withColumnRenamed("script_id", "video_id"), results, videos)
        regions = scan_regions(merge(windows), results)
        listed = F.array_sort(F.collect_list(F.struct("start_frame", "end_frame", "assets")))
        where = regions.groupBy("video_id").agg(listed.alias("regions")).select(
            "video_id", F.to_json(F.struct(F.lit(given.fps).alias("fps"), "regions")).alias("meta")
        )
        seen = captions(frames, readings, where, supplement_options(options, sections.get("Movie OCR")), with_stats=True).cache()
        found, found_counted = split_statistics(seen)
    numbers = results.count(), found.count()  # all is computed by now
    elapsed = round(time.monotonic() - begun, 3)
    LOG.info("%d lines and %d captions in %.1f s", *numbers, elapsed)
    settings = {k: str(v) for k, v in vars(options).items()}
    report(results, found, videos, settings, counted, found_counted, elapsed).select(F.col("report").alias("value")).write.mode(
        "overwrite"
    ).text(f"{given.output}.review")
    require_matches(results, found)
    matched = results.where("status = 'matched'").join(
        events.select(F.col("script_id").alias("video_id"), "idx", "style", "name"), ["video_id", "idx"]
    )
    scripted = matched.select("video_id", "start_frame", "end_frame", F.col("idx").alias("seq"), "text", "name", "style")
    extra = found.select("video_id", "start_frame", "end_frame", F.col("start_frame").alias("seq"), "text")
    lines = dialogue_lines(in_output_order(scripted, extra), given.fps, comments=not given.no_comments)
    write_documents(document(lines), given.output)
    if not found.isEmpty():
        write_documents(document(lines.where("src = 1")), f"{given.output}.movies")
    LOG.info("wrote %s", given.output)


def main(argv: list[str] | None = None) -> None:
    given = arguments(argv)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    (run_convert if given.command == "convert" else run_align)(spark, given)


if __name__ == "__main__":
    main()
