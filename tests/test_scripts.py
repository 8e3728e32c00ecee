import hashlib

import pytest
from pyspark.sql import functions as F

from lineweave.operators.script_events import script_events, titles, video_references
from lineweave.sinks.ass import script_document
from lineweave.sources.check_table import read_check_table, verify_fields, verify_source
from lineweave.sources.scripts import (
    ScriptError,
    field_id,
    parse_attributes,
    parse_clip,
    parse_fields,
    script_fields,
    script_files,
    script_lines,
)

SCRIPT = r"""[title title=Demo: Story One]
[message text=Hello\nworld name={user} clip=\{"_startTime":1.0,"_duration":2.5\}]
[narration text=（aside） clip=\{"_startTime":0.5,"_duration":0.25\}]
[choicegroup choices=[choice text=Yes] choices=[choice text=No]]
[video video=mv_01 clip=\{"_startTime":4.0,"_duration":3.0\}]
"""


@pytest.fixture
def lines(spark, tmp_path):
    (tmp_path / "demo.txt").write_bytes("﻿".encode() + SCRIPT.encode())
    return script_lines(script_files(spark, str(tmp_path)))


def test_fields_and_both_spellings_of_their_ids(lines):
    rows = script_fields(lines).orderBy("line", "key", "ordinal")
    got = [tuple(r) for r in rows.select(field_id(), field_id(True), "category", "source").collect()]
    assert got == [
        ("1:title:1", "1:title:1", "title", "Demo: Story One"),
        ("2:name:1", "2:name:1", "name", "{user}"),
        ("2:text:1", "2:text:1", "text", r"Hello\nworld"),
        ("3:text:1", "3:narration:1", "narration", "（aside）"),
        ("4:text:1", "4:choice:1", "choice", "Yes"),
        ("4:text:2", "4:choice:2", "choice", "No"),
    ]


def test_offsets_are_those_of_the_script(lines):
    for row in script_fields(lines).collect():
        assert SCRIPT[row.start : row.end] == row.source


def test_events_in_order_of_start(lines):
    got = [tuple(r) for r in script_events(lines).orderBy("idx").select("idx", "line", "start_s", "duration_s", "style", "name", "text").collect()]
    assert got == [
        (0, 3, 0.5, 0.25, "IdolyPride Gray", "", "（aside）"),
        (1, 2, 1.0, 2.5, "IdolyPride Normal", "マネージャー", r"Hello\Nworld"),
    ]


def test_video_references(lines):
    ref = video_references(lines, script_events(lines), offset=10).collect()
    assert [(r.asset, r.line, list(r.before), list(r.after), r.segment_start, r.segment_end) for r in ref] == [
        ("mv_01", 5, [10, 11], [], 10, 12)
    ]


def test_title_and_document(lines):
    assert titles(lines).first().title == "Demo__Story_One"
    content = script_document(script_events(lines)).first().content
    assert content.startswith("[Script Info]\n")
    assert "Dialogue: 0,0:00:00.50,0:00:00.75,IdolyPride Gray,,0,0,0,,\n" in content
    assert content.endswith("Comment: 0,0:00:01.00,0:00:03.50,IdolyPride Normal,マネージャー,0,0,0,,Hello\\Nworld\n")


def test_all_unicode_line_breaks_count(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("a\r\nb c\x0bd\n".encode())
    got = [(r.line, r.text, r.char_offset) for r in script_lines(script_files(spark, str(tmp_path / "a.txt"))).orderBy("line").collect()]
    assert got == [(1, "a", 0), (2, "b", 3), (3, "c", 5), (4, "d", 7)]


def test_values():
    assert parse_fields(r"[message text=a [b c=d] e\] f name=x y]")[0][4] == r"a [b c=d] e\] f"
    assert parse_fields("[message text= name=x]")[0][:5] == ("name", 1, "name", "x", "x")
    assert parse_fields("plain") == []
    tag, attrs = parse_attributes("[a x=[b y=1 z=2] w=3]")
    assert (tag, attrs) == ("a", {"x": "[b y=1 z=2]", "w": "3"})


@pytest.mark.parametrize("bad", ["[a x=1", "[a x=1 x=2]", "no command"])
def test_malformed_commands(bad):
    with pytest.raises(ScriptError):
        parse_attributes(bad)


@pytest.mark.parametrize("value", ['{"_startTime":-1,"_duration":1}', '{"_startTime":NaN,"_duration":1}', '{"_startTime":1,"_duration":Infinity}'])
def test_bad_clips(value):
    with pytest.raises(ValueError):
        parse_clip(value)
    with pytest.raises(KeyError):
        parse_clip('{"_startTime":1}')


@pytest.mark.parametrize(
    "line",
    [
        "[message text=a]",
        r'[message text=a text=b clip=\{"_startTime":1,"_duration":1\}]',
        r'[message text=a clip=\{"_startTime":-1,"_duration":1\}]',
    ],
)
def test_bad_dialogue_lines_fail(spark, line):
    lines = spark.createDataFrame([("s", 1, line, 0)], "script_id string, line int, text string, char_offset int")
    with pytest.raises(Exception, match="s:1"):
        script_events(lines).collect()


def test_check_table(spark, tmp_path, lines):
    path = tmp_path / "demo.txt"
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    rows = [
        "id,name,text,trans",
        "1:title:1,,Demo: Story One,",
        r"2:text:1,{user},Hello\nworld,",
        "3:narration:1,,other,",
        "4:choice:1,,Yes,",
        "9:text:1,,?,",
        f"info,demo.txt,{digest},",
        "译者,,,",
    ]
    (tmp_path / "c.csv").write_text("\n".join(rows) + "\n", encoding="utf-8")
    check = read_check_table(spark, str(tmp_path / "c.csv"))
    body = check.where("id NOT IN ('info', '译者')")
    faults = {tuple(r) for r in verify_fields(body, script_fields(lines)).collect()}
    assert faults == {("9:text:1", "unknown"), ("3:narration:1", "differs"), ("4:text:2", "missing")}
    assert verify_source(check, script_files(spark, str(path))).first().ok
    (tmp_path / "d.csv").write_text("id,name,text\n1,,x\n", encoding="utf-8")
    with pytest.raises(Exception):
        read_check_table(spark, str(tmp_path / "d.csv")).collect()


def test_repeated_check_row(spark, lines):
    body = spark.createDataFrame([("3:text:1", "（aside）"), ("3:narration:1", "（aside）")], "id string, text string")
    faults = [r.fault for r in verify_fields(body, script_fields(lines).where(F.col("line") == 3)).collect()]
    assert faults == ["repeated"]
