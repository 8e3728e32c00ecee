"""Command scripts: files to lines, lines to typed fields, attributes and clips.

A command is ``[tag key=value key=value ...]`` at the start of a line.  A value ends at the bracket
that closes its command or at a blank that another ``key=`` follows, brackets inside a value are
balanced, a backslash protects the next character.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, MapType, StringType, StructField, StructType

#: Line ends, as in Unicode text.
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"

# The keys that each command exposes as fields.
EXPOSED = {
    "message": ("text", "name"),
    "narration": ("text",),
    "title": ("title",),
    "choicegroup": ("text",),
    "choice": ("text",),
}
# Commands whose fields have a category other than their key.
CATEGORIES = {"choice": "choice", "choicegroup": "choice", "narration": "narration"}

COMMAND = re.compile(r"\[([A-Za-z_]\w*)\b", re.ASCII)
KEY = re.compile(r"(?<=[\[ ])([A-Za-z_]\w*)=", re.ASCII)
#: What can matter inside a value: a protected character, a bracket, a blank before another key.
_MARK = re.compile(r"\\.|[\[\]]| (?=[A-Za-z_]\w*=)", re.ASCII | re.DOTALL)

#: What is known of a field of a line.
FIELD_TYPE = StructType(
    [
        StructField("key", StringType()),
        StructField("ordinal", IntegerType()),
        StructField("category", StringType()),
        StructField("name", StringType()),
        StructField("source", StringType()),
        StructField("start", IntegerType()),
        StructField("end", IntegerType()),
    ]
)
_FIELDS = StructType([StructField("fields", ArrayType(FIELD_TYPE)), StructField("error", StringType())])
_COMMAND = StructType(
    [
        StructField("tag", StringType()),
        StructField("attrs", MapType(StringType(), StringType())),
        StructField("start_s", DoubleType()),
        StructField("duration_s", DoubleType()),
        StructField("error", StringType()),
    ]
)


class ScriptError(ValueError):
    """A script that does not follow the grammar."""


def value_end(line: str, start: int) -> int:
    """Where the value that begins at ``start`` ends."""
    level = 0
    for mark in _MARK.finditer(line, start):
        what = mark[0]
        if what == "[":
            level += 1
        elif what == "]":
            if not level:
                return mark.start()
            level -= 1
        elif what == " " and not level:
            return mark.start()
    raise ScriptError("a command is not closed")


def assignments(line: str) -> Iterator[tuple[str, int, int]]:
    """(key, start, end) of all values of a line, those inside other values included."""
    for m in KEY.finditer(line):
        yield m[1], m.end(), value_end(line, m.end())


def parse_fields(line: str) -> list[tuple]:
    """The exposed fields of a line, as rows of FIELD_TYPE; offsets are those in the line."""
    line = line.rstrip("\r\n")
    command = COMMAND.match(line)
    exposed = EXPOSED.get(command[1], ()) if command else ()
    if not exposed:
        return []
    speaker = next((m for m in KEY.finditer(line) if m[1] == "name"), None)
    name = line[speaker.end() : value_end(line, speaker.end())] if speaker else ""
    seen: dict[str, int] = {}
    rows = []
    for m in KEY.finditer(line):
        key = m[1]
        if key in exposed:
            start, end = m.end(), value_end(line, m.end())
            if end > start:
                seen[key] = seen.get(key, 0) + 1
                rows.append((key, seen[key], CATEGORIES.get(command[1], key), name, line[start:end], start, end))
    return rows


def parse_attributes(line: str) -> tuple[str, dict[str, str]]:
    """The tag and the attributes on the top level of a command."""
    line = line.rstrip("\r\n")
    command = COMMAND.match(line)
    if not command:
        raise ScriptError("not a command")
    found: dict[str, str] = {}
    behind = 0
    for m in KEY.finditer(line):
        if m.start() >= behind:
            if m[1] in found:
                raise ScriptError(f"attribute {m[1]} is given twice")
            behind = value_end(line, m.end())
            found[m[1]] = line[m.end() : behind]
    return command[1], found


def parse_clip(value: str) -> tuple[float, float]:
    """Start and duration of a clip attribute."""
    data = json.loads(value.replace(r"\{", "{").replace(r"\}", "}"))
    times = tuple(float(data[k]) for k in ("_startTime", "_duration"))
    if not all(math.isfinite(t) and t >= 0 for t in times):
        raise ScriptError("clip times must be finite and not negative")
    return times


@F.pandas_udf(_FIELDS)
def line_fields(lines: pd.Series) -> pd.DataFrame:
    names = FIELD_TYPE.names
    out: list[tuple] = []
    for line in lines:
        try:
            out.append(([dict(zip(names, row, strict=True)) for row in parse_fields(line or "")], None))
        except ScriptError as error:
            out.append(([], str(error)))
    return pd.DataFrame(out, columns=["fields", "error"])


@F.pandas_udf(_COMMAND)
def line_command(lines: pd.Series) -> pd.DataFrame:
    """Attributes and clip; ``error`` says why either is missing."""
    out = []
    for line in lines:
        tag, attrs, clip, error = None, None, (None, None), None
        try:
            tag, attrs = parse_attributes(line or "")
            clip = parse_clip(attrs["clip"])
        except KeyError as missing:
            error = f"no {missing.args[0]}"
        except (ValueError, TypeError) as bad:
            error = str(bad)
        out.append((tag, attrs, *clip, error))
    return pd.DataFrame(out, columns=["tag", "attrs", "start_s", "duration_s", "error"]).astype(
        {"start_s": "float64", "duration_s": "float64"}
    )


def script_files(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """(script_id, path, content) of a script or of all .txt files under a folder.

    A relative path that does not exist is looked for under ``root``."""
    if root and not Path(path).is_absolute() and "://" not in path and not Path(path).exists():
        path = f"{root.rstrip('/')}/{path}"
    reader = spark.read.format("binaryFile")
    if not path.endswith(".txt"):
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt")
    return reader.load(path).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("script_id"), "path", "content"
    )


def split_lines(scripts: DataFrame, text: Column) -> DataFrame:
    """(script_id, line, text, char_offset): logical lines, numbered from 1, with their places in the script."""
    bare = F.regexp_replace(text, "^\ufeff", "")
    ends = F.regexp_extract_all(bare, F.lit(f"({LINE_BREAK})"), 1)
    pieces = F.split(bare, LINE_BREAK)
    line = F.posexplode(F.arrays_zip(pieces.alias("t"), F.concat(F.lit(F.array(F.lit(""))), ends).alias("b")))
    rows = scripts.select("script_id", line).select(
        "script_id", (F.col("pos") + 1).alias("line"), F.col("col.t").alias("text"), F.col("col.b").alias("brk")
    )
    along = Window.partitionBy("script_id").orderBy("line")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    last = F.max("line").over(Window.partitionBy("script_id"))
    return (
        rows.withColumn(
            "char_offset",
            (
                F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))
                + F.sum(F.length("brk")).over(along.rowsBetween(Window.unboundedPreceding, 0))
            ).cast("int"),
        )
        .withColumn("last", last)
        # a text that ends with a line break has no line after it
        .where((F.col("text") != "") | (F.col("line") < F.col("last")))
        .select("script_id", "line", "text", "char_offset")
    )


def script_lines(files: DataFrame) -> DataFrame:
    return split_lines(files, F.decode("content", "UTF-8"))


def script_fields(lines: DataFrame, strict: bool = True) -> DataFrame:
    """All exposed fields with offsets in the script; with ``strict`` a malformed line fails the query."""
    parsed = lines.withColumn("p", line_fields("text"))
    if strict:
        parsed = parsed.withColumn(
            "p",
            F.when(F.col("p.error").isNull(), F.col("p")).otherwise(
                F.raise_error(F.concat_ws(":", "script_id", "line", "p.error")).cast(parsed.schema["p"].dataType)
            ),
        )
    return parsed.select("script_id", "line", "char_offset", F.inline("p.fields")).select(
        "script_id",
        "line",
        "key",
        "ordinal",
        "category",
        "name",
        "source",
        (F.col("char_offset") + F.col("start")).alias("start"),
        (F.col("char_offset") + F.col("end")).alias("end"),
    )


def field_id(category: bool = False) -> Column:
    """line:key:ordinal, or with the category in place of the key."""
    return F.concat_ws(":", "line", "category" if category else "key", "ordinal")


def is_dialogue() -> Column:
    return (F.col("key") == "text") & F.col("category").isin("text", "narration")
