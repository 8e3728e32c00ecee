"""Script lines to subtitle events and video references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_SPEAKER, USER_TAG, file_name, with_player
from ..sources.scripts import is_dialogue, line_command, script_fields

#: Seconds by which a reference may overlap its neighbours.
TOLERANCE = 0.1
# What narration lines contain, and the names of the two styles.
NARRATION = "narration text="
NORMAL, GRAY = "IdolyPride Normal", "IdolyPride Gray"


def display_text(source: Column, category: Column, player: str = "") -> tuple[Column, Column]:
    """The text that is shown, and whether it is shown gray."""
    text = with_player(source, player)
    told = category == "narration"
    gray = told | F.contains(text, F.lit("（")) | F.contains(text, F.lit("）"))
    text = F.when(told, text).otherwise(F.translate(text, "（）", ""))
    return F.replace(text, F.lit(r"\n"), F.lit(r"\N")), gray


def script_events(lines: DataFrame, player: str = "") -> DataFrame:
    """Timed events of scripts (script_id, line, text, char_offset), numbered in order of start.

    Two texts on a line, or a dialogue line without a valid clip, fail the query.
    """
    found = script_fields(lines)
    spoken = (
        found.where(is_dialogue())
        .groupBy("script_id", "line")
        .agg(F.count("*").alias("texts"), F.min_by(F.struct("source", "category"), "ordinal").alias("f"))
    )
    names = (
        found.where("key = 'name'").groupBy("script_id", "line").agg(F.min_by("source", "ordinal").alias("speaker"))
    )
    place = F.concat_ws(":", "script_id", "line")
    rows = (
        lines.join(spoken, ["script_id", "line"])
        .join(names, ["script_id", "line"], "left")
        .withColumn("c", line_command("text"))
        .withColumn(
            "start_s",
            F.when(F.col("texts") > 1, F.raise_error(F.concat(place, F.lit(": several texts"))).cast("double"))
            .when(F.col("c.error").isNotNull(), F.raise_error(F.concat(place, F.lit(": "), "c.error")).cast("double"))
            .otherwise(F.col("c.start_s")),
        )
    )
    text, gray = display_text(F.col("f.source"), F.col("f.category"), player)
    speaker = F.coalesce("speaker", F.lit(""))
    in_order = Window.partitionBy("script_id").orderBy("start_s", "line")
    return rows.select(
        "script_id",
        (F.row_number().over(in_order) - 1).alias("idx"),
        "line",
        "start_s",
        F.col("c.duration_s").alias("duration_s"),
        F.when(gray, GRAY).otherwise(NORMAL).alias("style"),
        F.when(F.contains(F.col("text"), F.lit(NARRATION)), "")
        .when(speaker == USER_TAG, DEFAULT_SPEAKER)
        .otherwise(speaker)
        .alias("name"),
        text.alias("text"),
    )


def titles(lines: DataFrame) -> DataFrame:
    """(script_id, title): the first title as a file name, else the script's name without its suffix."""
    first = (
        script_fields(lines).where("key = 'title'")
        .groupBy("script_id").agg(F.min_by("source", F.struct("line", "ordinal")).alias("source"))
    )
    stem = F.regexp_replace("script_id", r"\.[^.]*$", "")
    return lines.select("script_id").distinct().join(first, "script_id", "left").select(
        "script_id", F.coalesce(file_name(F.col("source")), stem).alias("title")
    )


def neighbours(refs: DataFrame, events: DataFrame) -> DataFrame:
    """References (script_id, line, script_start, script_duration) with the events that end before and begin after."""
    end = F.col("r.script_start") + F.col("r.script_duration")
    last = F.col("e.start_s") + F.col("e.duration_s")
    joined = refs.alias("r").join(events.alias("e"), F.col("r.script_id") == F.col("e.script_id"), "left")
    pick = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("e.idx"))))
    return joined.groupBy(*[F.col(f"r.{c}").alias(c) for c in refs.columns]).agg(
        pick(last <= F.col("r.script_start") + TOLERANCE).alias("before"),
        pick(F.col("e.start_s") >= end - TOLERANCE).alias("after"),
    )


def video_references(lines: DataFrame, events: DataFrame, offset: int = 0) -> DataFrame:
    """References to videos with the indices of neighbouring events, shifted by ``offset``."""
    refs = (
        lines.where(F.col("text").rlike(r"^\[video\b"))
        .withColumn("c", line_command("text"))
        .where("c.error IS NULL AND coalesce(try_element_at(c.attrs, 'video'), '') <> '' AND c.duration_s > 0")
        .select(
            "script_id",
            "line",
            F.element_at("c.attrs", "video").alias("asset"),
            F.col("c.start_s").alias("script_start"),
            F.col("c.duration_s").alias("script_duration"),
        )
    )
    total = events.groupBy("script_id").agg(F.count("*").alias("n"))
    shift = lambda c: F.transform(c, lambda i: i + offset)
    return (
        neighbours(refs, events)
        .join(total, "script_id", "left")
        .withColumns(
            {
                "before": shift("before"),
                "after": shift("after"),
                "segment_start": F.lit(offset),
                "segment_end": (F.coalesce("n", F.lit(0)) + offset).cast("int"),
            }
        )
        .drop("n")
    )


def concat_parts(parts: DataFrame) -> DataFrame:
    """Events of several parts (recording, part, idx, ...) numbered on: part after part, each in its own order."""
    sizes = parts.groupBy("recording", "part").agg(F.count("*").alias("n"))
    along = Window.partitionBy("recording").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("shift", F.coalesce(F.sum("n").over(along), F.lit(0))).drop("n")
    return parts.join(shift, ["recording", "part"]).withColumn("idx", F.col("idx") + F.col("shift")).drop("shift")


def load_events(parts: list[DataFrame], gap_before_second: float = 0.0, player: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, references, gaps) of scripts of one or two parts, each given as lines with the same script_id.

    Parts keep their own order, the second goes on numbering where the first ends.  The gap (seconds) stands
    before the second part's first event.
    """
    numbered = [
        script_events(lines, player).withColumns({"recording": F.col("script_id"), "part": F.lit(n)})
        for n, lines in enumerate(parts)
    ]
    events = concat_parts(numbered[0] if len(numbered) == 1 else numbered[0].unionByName(numbered[1]))
    sizes = events.where("part = 0").groupBy("script_id").agg(F.count("*").cast("int").alias("shift"))
    refs = video_references(parts[0], numbered[0])
    if len(parts) > 1:
        shifted = video_references(parts[1], numbered[1]).join(sizes, "script_id", "left")
        by = F.coalesce("shift", F.lit(0))
        refs = refs.unionByName(
            shifted.withColumns(
                {
                    "before": F.transform("before", lambda i: i + by),
                    "after": F.transform("after", lambda i: i + by),
                    "segment_start": F.col("segment_start") + by,
                    "segment_end": F.col("segment_end") + by,
                }
            ).drop("shift")
        )
    gaps = sizes.select("script_id", F.col("shift").alias("before_idx"), F.lit(float(gap_before_second)).alias("seconds"))
    return events.drop("recording"), refs, gaps.where("seconds > 0") if len(parts) > 1 else gaps.limit(0)
