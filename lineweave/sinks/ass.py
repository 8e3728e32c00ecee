"""Subtitle text (ASS): headers, styles, ordered event lines, one document per recording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_SPEAKER, USER_TAG, escape_markup
from ..functions.timefmt import frame_to_time, seconds_to_time

BOM = "﻿"
# The columns of event lines and styles, and the parts of a document's head.
EVENT_COLUMNS = "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"
STYLE_COLUMNS = (
    "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, "
    "StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
)
DEFAULT_STYLES = (
    ("IdolyPride Normal", "方正正中黑_GBK", 63, "&H00FEFEFE", "&H000000FF", "&H00000000", "&H00000000",
     -1, 0, 0, 0, 100, 100, 5, 0, 1, 6, 0, 2, 10, 10, 200, 1),
    ("IdolyPride Gray", "方正正中黑_GBK", 63, "&H00B4B4B4", "&H000000FF", "&H00000000", "&H00000000",
     -1, 0, 0, 0, 100, 100, 5, 0, 1, 6, 0, 2, 10, 10, 200, 1),
)
SCRIPT_INFO = {
    "Title": "IDOLY PRIDE STORY",
    "ScriptType": "v4.00+",
    "WrapStyle": "0",
    "YCbCr Matrix": "TV.601",
    "PlayResX": "1920",
    "PlayResY": "1080",
}
PROJECT = {
    "Last Style Storage": "Default",
    "Audio File": "",
    "Video File": "",
    "Video AR Mode": "",
    "Video AR Value": "",
    "Video Zoom Percent": "",
    "Scroll Position": "",
    "Active Line": "",
    "Video Position": "",
}
NORMAL_STYLE, FOUND_NAME = "IdolyPride Normal", "OCR"


def style_line(style: Sequence[object]) -> str:
    if len(style) != len(STYLE_COLUMNS.split(", ")):
        raise ValueError("a style has 23 attributes")
    return "Style: " + ",".join(map(str, style))


def head(styles: Sequence[Sequence[object]] = DEFAULT_STYLES) -> str:
    """All sections up to the first event line."""
    section = lambda title, values: [f"[{title}]", *[f"{k}: {v}" for k, v in values.items()], ""]
    return "\n".join(
        [
            *section("Script Info", SCRIPT_INFO),
            *section("Aegisub Project Garbage", PROJECT),
            "[V4+ Styles]",
            f"Format: {STYLE_COLUMNS}",
            *[style_line(s) for s in styles],
            "",
            "[Events]",
            f"Format: {EVENT_COLUMNS}",
        ]
    )


def event_line(kind: str, start: Column, end: Column, text: Column) -> Column:
    """``kind``: Dialogue or Comment, with the row's style and name."""
    return F.concat(
        F.lit(f"{kind}: 0,"), start, F.lit(","), end, F.lit(","), F.col("style"), F.lit(","), F.col("name"), F.lit(",0,0,0,,"), text
    )


def in_output_order(scripted: DataFrame, found: DataFrame, order: str = "start_frame") -> DataFrame:
    """Script rows and rows that were found without a script, numbered by start; script rows come first on ties.

    Found text is literal: whatever would be markup is replaced.
    """
    plain = found.withColumns(
        {"text": escape_markup(F.col("text")), "name": F.lit(FOUND_NAME), "src": F.lit(1)}
    )
    if "style" not in plain.columns:
        plain = plain.withColumn("style", F.lit(NORMAL_STYLE))
    rows = scripted.withColumn("src", F.lit(0)).unionByName(plain, allowMissingColumns=True)
    place = Window.partitionBy("video_id").orderBy(order, "src", "seq")
    return rows.withColumn("place", F.row_number().over(place))


def dialogue_lines(rows: DataFrame, fps: str, comments: bool) -> DataFrame:
    """``line``: a dialogue line with the text in it, or (with comments) without, and the text in a comment line below."""
    start, end = frame_to_time(F.col("start_frame"), fps), frame_to_time(F.col("end_frame"), fps)
    shown = F.replace(F.col("text"), F.lit(USER_TAG), F.lit(DEFAULT_SPEAKER))
    if not comments:
        return rows.withColumn("line", event_line("Dialogue", start, end, F.col("text")))
    return rows.withColumn(
        "line",
        F.concat_ws("\n", event_line("Dialogue", start, end, F.lit("")), event_line("Comment", start, end, shown)),
    )


def document(rows: DataFrame, styles: Sequence[Sequence[object]] = DEFAULT_STYLES) -> DataFrame:
    """(video_id, content): one document per recording from lines with places."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda r: r["line"])
    body = rows.groupBy("video_id").agg(F.array_join(lines, "\n").alias("body"))
    return body.select(
        "video_id", F.concat(F.lit(BOM + head(styles) + "\n\n"), "body", F.lit("\n")).alias("content")
    )


def script_document(events: DataFrame, styles: Sequence[Sequence[object]] = DEFAULT_STYLES) -> DataFrame:
    """A document per script by the script's own times, dialogue and comment lines, without a byte-order mark."""
    start = seconds_to_time(F.col("start_s"))
    end = seconds_to_time(F.col("start_s") + F.col("duration_s"))
    shown = F.replace(F.col("text"), F.lit(USER_TAG), F.lit(DEFAULT_SPEAKER))
    rows = events.select(
        F.col("script_id").alias("video_id"),
        F.col("idx").alias("place"),
        F.concat_ws("\n", event_line("Dialogue", start, end, F.lit("")), event_line("Comment", start, end, shown)).alias("line"),
    )
    return document(rows, styles).select(
        F.col("video_id").alias("script_id"), F.substring("content", 2, 1 << 30).alias("content")
    )


def write_documents(documents: DataFrame, path: str) -> None:
    """One file per recording: the content column as text, partitioned by video_id."""
    documents.select("video_id", F.col("content").alias("value")).write.mode("overwrite").partitionBy("video_id").option(
        "lineSep", "\n"
    ).text(path)
