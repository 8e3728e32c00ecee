"""Queries of semi-structured parsing and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.script_events import script_events, video_references
from ..sinks.ass import head, script_document
from ..sources.check_table import verify_fields
from ..sources.scripts import field_id, line_command, script_fields, script_lines
from .registry import query
from .surrogates import table
from .timing import format_sql

_SAFE = r"[^A-Za-z0-9 .,!?]"


@query(
    """SELECT event_id, error IS NULL AS valid, error, CASE WHEN error IS NULL THEN k END AS start_s,
        CASE WHEN error IS NULL THEN d END AS duration_s
    FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(event_id % 7 - 1 AS DOUBLE) AS d,
        CASE WHEN event_id % 13 = 0 THEN 'attribute clip is given twice' WHEN event_id % 17 = 0 THEN 'a command is not closed'
            WHEN event_id % 11 = 0 THEN 'no _startTime' WHEN event_id % 7 = 0 THEN 'clip times must be finite and not negative' END AS error
        FROM events)"""
)
def json_extract_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commands with a clip, some of them faulty: given twice, not closed, without a start, or negative."""
    number = F.col("event_id")
    start = F.when(number % 11 == 0, F.lit("")).otherwise(F.concat(F.lit('"_startTime":'), F.get_json_object("props", "$.k"), F.lit(",")))
    clip = F.concat(F.lit(r" clip=\{"), start, F.lit('"_duration":'), (number % 7 - 1).cast("string"), F.lit(r"\}"))
    twice = F.when(number % 13 == 0, clip).otherwise(F.lit(""))
    end = F.when(number % 17 == 0, F.lit("")).otherwise(F.lit("]"))
    parsed = table(spark, sf_dir, "events").withColumn("c", line_command(F.concat(F.lit("[event"), clip, twice, end)))
    return parsed.select("event_id", F.col("c.error").isNull().alias("valid"), "c.error", "c.start_s", "c.duration_s")


@query(
    """SELECT page_id, 'page' AS tag, 4::BIGINT AS n_tags, md5(concat_ws('|', url, page_id, length(html), '[x=1 y=2]')) AS digest FROM pages"""
)
def tag_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as commands; the assignments inside a bracketed value are no attributes of the command."""
    line = F.concat(
        F.lit("[page url="), "url", F.lit(" id="), F.col("page_id").cast("string"), F.lit(" note=[x=1 y=2] size="),
        F.length("html").cast("string"), F.lit("]"),
    )
    parsed = table(spark, sf_dir, "pages").withColumn("c", line_command(line))
    values = [F.try_element_at("c.attrs", F.lit(k)) for k in ("url", "id", "size", "note")]
    return parsed.select(
        "page_id", "c.tag", F.size("c.attrs").cast("long").alias("n_tags"), F.md5(F.concat_ws("|", *values)).alias("digest")
    )


@query(
    """WITH p AS (SELECT doc_id, regexp_split_to_array(text, '\\n') AS t FROM documents),
    l AS (SELECT doc_id, unnest(t) AS text, unnest(range(1, len(t) + 1)) AS line, len(t) AS n FROM p)
    SELECT doc_id, CAST(line AS INTEGER) AS line, md5(text) AS digest,
        CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS INTEGER) AS char_offset
    FROM l QUALIFY text <> '' OR line < n"""
)
def script_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as script files, from bytes to numbered lines."""
    files = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("script_id"), F.encode(F.concat(F.lit("\ufeff"), "text"), "UTF-8").alias("content")
    )
    return script_lines(files).select(F.col("script_id").cast("long").alias("doc_id"), "line", F.md5("text").alias("digest"), "char_offset")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a script: user turns are messages, others narrations."""
    said = F.regexp_replace("text", _SAFE, "")
    clip = F.concat(
        F.lit(r' clip=\{"_startTime":'), (F.col("turn") * 2).cast("string"), F.lit(r',"_duration":1.5\}]')
    )
    user = F.col("role") == "user"
    text = F.concat(
        F.when(user, F.concat(F.lit("[message text=["), said, F.lit("] name="), "role")).otherwise(
            F.concat(F.lit("[narration text=("), said, F.lit(")"))
        ),
        clip,
    )
    in_order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("script_id"),
        (F.col("turn") + 1).cast("int").alias("line"),
        text.alias("text"),
        F.coalesce(F.sum(F.length(text) + 1).over(in_order), F.lit(0)).cast("int").alias("char_offset"),
    )


_SAID = r"regexp_replace(text, '[^A-Za-z0-9 .,!?]', '', 'g')"


@query(
    rf"""WITH s AS (SELECT conv_id, turn, role, {_SAID} AS said FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS script_id, CAST(turn + 1 AS INTEGER) AS line, 'text' AS key,
        CASE WHEN role = 'user' THEN 'text' ELSE 'narration' END AS category,
        CASE WHEN role = 'user' THEN 'user' ELSE '' END AS name,
        CASE WHEN role = 'user' THEN '[' || said || ']' ELSE '(' || said || ')' END AS source FROM s
    UNION ALL SELECT CAST(conv_id AS VARCHAR), CAST(turn + 1 AS INTEGER), 'name', 'name', 'user', 'user' FROM s WHERE role = 'user'"""
)
def bracket_value_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script_fields(_lines(spark, sf_dir)).select("script_id", "line", "key", "category", "name", "source")


@query(
    r"""SELECT CAST(conv_id AS VARCHAR) AS script_id, CAST(turn + 1 AS INTEGER) AS line,
        CASE WHEN role = 'user' THEN 'message' ELSE 'narration' END AS tag, CASE WHEN role = 'user' THEN 'user' END AS speaker,
        CAST(turn * 2 AS DOUBLE) AS start_s, 1.5::DOUBLE AS duration_s FROM conversations"""
)
def command_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _lines(spark, sf_dir).withColumn("c", line_command("text"))
    return parsed.select(
        "script_id",
        "line",
        "c.tag",
        F.try_element_at("c.attrs", F.lit("name")).alias("speaker"),
        "c.start_s",
        "c.duration_s",
    )


@query(
    rf"""SELECT CAST(conv_id AS VARCHAR) AS script_id,
        CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS idx,
        CASE WHEN role = 'user' THEN 'IdolyPride Normal' ELSE 'IdolyPride Gray' END AS style,
        CASE WHEN role = 'user' THEN 'user' ELSE '' END AS name,
        CASE WHEN role = 'user' THEN '[' || {_SAID} || ']' ELSE '(' || {_SAID} || ')' END AS text FROM conversations"""
)
def script_to_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script_events(_lines(spark, sf_dir)).select("script_id", "idx", "style", "name", "text")


_HEAD_SQL = head().replace("'", "''").replace("\n", "' || chr(10) || '")


@query(
    rf"""WITH s AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '[' || {_SAID} || ']' ELSE '(' || {_SAID} || ')' END AS text,
        CASE WHEN role = 'user' THEN 'user' ELSE '' END AS name,
        CASE WHEN role = 'user' THEN 'IdolyPride Normal' ELSE 'IdolyPride Gray' END AS style,
        {format_sql("turn * 200")} || ',' || {format_sql("turn * 200 + 150")} AS times FROM conversations),
    e AS (SELECT conv_id, turn, 'Dialogue: 0,' || times || ',' || style || ',' || name || ',0,0,0,,' || chr(10) ||
        'Comment: 0,' || times || ',' || style || ',' || name || ',0,0,0,,' || text AS line FROM s),
    d AS (SELECT conv_id, '{_HEAD_SQL}' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY turn) || chr(10) AS content FROM e GROUP BY conv_id)
    SELECT CAST(conv_id AS VARCHAR) AS script_id, sha256(content) AS sha256, length(content) AS n_chars FROM d"""
)
def script_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as subtitle documents by the script's own times."""
    documents = script_document(script_events(_lines(spark, sf_dir)))
    return documents.select("script_id", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("n_chars"))


@query(
    """WITH r AS (SELECT conv_id, turn, turn * 2 - 0.25 AS s, turn * 2 + 1.0 AS e FROM conversations WHERE turn % 3 = 1),
    c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, turn * 2 AS s, turn * 2 + 1.5 AS e FROM conversations)
    SELECT CAST(r.conv_id AS VARCHAR) AS script_id, 'v' || CAST(r.turn AS VARCHAR) AS asset, r.s::DOUBLE AS script_start,
        coalesce(string_agg(CASE WHEN c.e <= r.s + 0.1 THEN CAST(c.idx AS VARCHAR) END, ',' ORDER BY c.idx), '') AS before,
        coalesce(string_agg(CASE WHEN c.s >= r.e - 0.1 THEN CAST(c.idx AS VARCHAR) END, ',' ORDER BY c.idx), '') AS after,
        CAST(count(*) AS INTEGER) AS segment_end
    FROM r JOIN c USING (conv_id) GROUP BY r.conv_id, r.turn, r.s"""
)
def video_reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos between the turns of conversations, with the lines before and after them; those without an asset or a
    duration do not count."""
    spoken = _lines(spark, sf_dir)
    turn = F.col("line") - 1
    clip = lambda start, length: F.concat(F.lit(r' clip=\{"_startTime":'), start.cast("string"), F.lit(f',"_duration":{length}' + r"\}]"))
    videos = spoken.where(turn % 3 == 1).select(
        "script_id",
        (F.col("line") + 100_000).alias("line"),
        F.explode(
            F.array(
                F.concat(F.lit("[video video=v"), turn.cast("string"), clip(turn * 2 - 0.25, 1.25)),
                F.concat(F.lit("[video video=none"), clip(turn * 2, 0)),
                F.concat(F.lit("[video name=other"), clip(turn * 2, 1)),
            )
        ).alias("text"),
        "char_offset",
    )
    found = video_references(spoken.unionByName(videos), script_events(spoken))
    return found.select(
        "script_id", "asset", "script_start", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"), "segment_end"
    )


@query(
    """SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS INTEGER) AS ordinal,
    CAST(turn + 1 AS VARCHAR) || ':' || role || ':' ||
    CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS VARCHAR) AS field FROM conversations"""
)
def field_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("conv_id", "role").orderBy("turn")
    return (
        table(spark, sf_dir, "conversations")
        .withColumns({"ordinal": F.row_number().over(own), "line": F.col("turn") + 1, "key": F.col("role")})
        .select("conv_id", "turn", "role", "ordinal", field_id().alias("field"))
    )


@query(
    """WITH c AS (SELECT l.doc_id, l.quality, CASE WHEN l.doc_id % 11 = 0 THEN 'x' || CAST(l.doc_id AS VARCHAR)
            WHEN l.doc_id % 2 = 0 THEN CAST(l.doc_id AS VARCHAR) || ':text:1'
            ELSE CAST(l.doc_id AS VARCHAR) || ':' || d.lang || ':1' END AS id
        FROM labels l JOIN documents d USING (doc_id))
    SELECT id, 'unknown' AS fault FROM c WHERE doc_id % 11 = 0
    UNION ALL SELECT id, 'differs' FROM c WHERE doc_id % 11 <> 0 AND quality = 0
    UNION ALL SELECT CAST(doc_id AS VARCHAR) || ':text:1', 'missing' FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM c WHERE doc_id % 11 <> 0)"""
)
def either_key_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    fields = documents.select(
        F.col("doc_id").alias("line"),
        F.lit("text").alias("key"),
        F.lit(1).alias("ordinal"),
        F.col("lang").alias("category"),
        F.md5("text").alias("source"),
    )
    key = F.col("doc_id").cast("string")
    check = table(spark, sf_dir, "labels").join(documents.select("doc_id", "lang", "text"), "doc_id").select(
        F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("x"), key))
        .when(F.col("doc_id") % 2 == 0, F.concat(key, F.lit(":text:1")))
        .otherwise(F.concat(key, F.lit(":"), "lang", F.lit(":1")))
        .alias("id"),
        F.when(F.col("quality") == 0, "").otherwise(F.md5("text")).alias("text"),
    )
    return verify_fields(check, fields)
