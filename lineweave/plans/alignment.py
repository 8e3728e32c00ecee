"""Queries of the order-dependent state machines, over recordings made from conversations and events."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Options, supplement_options
from ..functions.pixels import edge_overlap
from ..sinks.ass import BOM, dialogue_lines, document, head, in_output_order
from ..sinks.report import report
from ..streaming.run import align, captions, split_statistics
from ..streaming.templates import LinePlacer
from .registry import query
from .surrogates import FRAMES_SQL
from .surrogates import frames as event_frames
from .surrogates import SCRIPT_SQL, script, table
from .timing import format_sql, frame_sql

FPS = "10"
PER_LINE = 30
H, W = 8, 64


def _mask(*seed) -> Column:
    """A pseudo-random 8 x 64 mask of one bit in sixteen."""

    def row(k: int) -> Column:
        out = F.xxhash64(*seed, F.lit(k))
        for salt in (100, 200, 300):
            out = out.bitwiseAND(F.xxhash64(*seed, F.lit(k + salt)))
        return out

    return F.unhex(F.concat(*[F.lpad(F.hex(row(k)), 16, "0") for k in range(H)]))


def recordings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames, readings and meta rows: line i is on screen in frames 30 i + 2 up to 30 i + 22, and is read with noise."""
    lines = script(spark, sf_dir).withColumn("video_id", F.col("conv_id").cast("string"))
    slots = lines.select(
        "video_id", "conv_id", "idx", "text", F.explode(F.sequence(F.lit(0), F.lit(PER_LINE - 1))).alias("k")
    ).withColumn("frame_index", F.col("idx") * PER_LINE + F.col("k"))
    shown = (F.col("k") >= 2) & (F.col("k") < 22)
    frames = slots.select(
        "video_id",
        "frame_index",
        F.lit(H).alias("h"),
        F.lit(W).alias("w"),
        F.when(shown, _mask(F.col("conv_id"), F.col("idx"))).otherwise(F.lit(bytes(H * W // 8))).alias("edge"),
    )
    at = (F.lit(1) + (7 * F.col("conv_id") + 3 * F.col("idx") + F.col("k")) % F.length("text")).cast("int")
    noisy = F.concat(
        F.substring(F.col("text"), F.lit(1), at - 1), F.lit("x"), F.substring(F.col("text"), at + 1, F.length("text"))
    )
    full = F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(W).alias("x1"), F.lit(H).alias("y1"))
    readings = slots.where(shown).select(
        "video_id",
        "frame_index",
        F.lit(0).alias("attempt"),
        F.when(F.col("k") % 3 == 0, noisy).otherwise(F.col("text")).alias("text"),
        (F.lit(0.86) + (F.col("k") % 5) / 50).alias("confidence"),
        full.alias("box"),
        F.lit("sample").alias("model"),
    )
    last = F.max("idx").over(Window.partitionBy("video_id"))
    every = lines.withColumn("frames", (last + 1) * PER_LINE)
    said = F.array_sort(F.collect_list(F.struct("idx", "text", F.lit(2.0).alias("duration"))))
    meta = every.groupBy("video_id").agg(said.alias("lines"), F.max("frames").alias("n")).select(
        "video_id",
        F.to_json(
            F.struct(
                F.lit(FPS).alias("fps"),
                "lines",
                F.array(F.struct(F.lit(0).alias("start_frame"), F.col("n").alias("end_frame"))).alias("regions"),
            )
        ).alias("meta"),
    )
    return frames, readings, meta


# The recordings are made so that what is on screen, and when, is known.


@query(
    f"""WITH {SCRIPT_SQL} SELECT CAST(conv_id AS VARCHAR) AS video_id, CAST(idx AS INTEGER) AS idx, 'matched' AS status,
    {PER_LINE} * idx + 2 AS start_frame, {PER_LINE} * idx + 22 AS end_frame, 'visual_change' AS end_reason FROM lines"""
)
def align_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(*recordings(spark, sf_dir))
    return found.select("video_id", "idx", "status", "start_frame", "end_frame", "end_reason")


@query(
    f"""WITH {SCRIPT_SQL} SELECT CAST(conv_id AS VARCHAR) AS video_id,
    {PER_LINE} * idx + 2 AS start_frame, {PER_LINE} * idx + 22 AS end_frame, 'visual_change' AS end_reason FROM lines"""
)
def align_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = captions(*recordings(spark, sf_dir), supplement_options(Options()))
    return found.select("video_id", "start_frame", "end_frame", "end_reason")


_TIMES_SQL = f"{format_sql(frame_sql(f'({PER_LINE} * idx + 2)', FPS))} || ',' || {format_sql(frame_sql(f'({PER_LINE} * idx + 22)', FPS))}"
_HEAD_SQL = (BOM + head()).replace("'", "''").replace("\n", "' || chr(10) || '")


@query(
    f"""WITH {SCRIPT_SQL}, t AS (SELECT conv_id, idx, text, {_TIMES_SQL} || ',IdolyPride Normal,,0,0,0,,' AS rest FROM lines),
    d AS (SELECT conv_id, '{_HEAD_SQL}' || chr(10) || chr(10) || string_agg('Dialogue: 0,' || rest || chr(10) || 'Comment: 0,' || rest || text,
        chr(10) ORDER BY idx) || chr(10) AS content FROM t GROUP BY conv_id)
    SELECT CAST(conv_id AS VARCHAR) AS video_id, sha256(content) AS sha256, length(content) AS n_chars FROM d"""
)
def subtitle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned lines as one subtitle document per recording."""
    found = align(*recordings(spark, sf_dir)).where("status = 'matched'").select(
        "video_id",
        "start_frame",
        "end_frame",
        F.col("idx").alias("seq"),
        "text",
        F.lit("").alias("name"),
        F.lit("IdolyPride Normal").alias("style"),
    )
    lines = dialogue_lines(in_output_order(found, found.limit(0)), FPS, comments=True)
    return document(lines).select("video_id", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("n_chars"))


_COUNTED = {"frames": f"{PER_LINE} * max(idx) + 25", "peak_buffer_frames": "21", "peak_buffer_bytes": f"21 * {H * W}"}


@query(
    f"""WITH {SCRIPT_SQL} SELECT CAST(conv_id AS VARCHAR) AS video_id, count(*) AS matched, 0::BIGINT AS unmatched,
        {", ".join(f"CAST({sql} AS BIGINT) AS {name}" for name, sql in _COUNTED.items())},
        CAST({PER_LINE} * (max(idx) + 1) AS BIGINT) AS video_frames, '5' AS lookahead,
        md5(string_agg(CAST(idx AS VARCHAR) || ':' || CAST({PER_LINE} * idx + 2 AS VARCHAR) || '-' || CAST({PER_LINE} * idx + 22 AS VARCHAR),
            ',' ORDER BY idx)) AS events
    FROM lines GROUP BY conv_id"""
)
def evidence_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of every recording as JSON, read again: what was matched, where, and what the machine counted."""
    parts = recordings(spark, sf_dir)
    results, counted = split_statistics(align(*parts, with_stats=True))
    videos = parts[0].groupBy("video_id").agg(F.lit(FPS).alias("fps"), F.count("*").alias("total_frames"))
    none = results.select("video_id", "text").limit(0)
    written = report(results, none, videos, {"lookahead": "5"}, counted)
    read = written.select(
        "video_id",
        F.from_json(
            "report",
            "stats struct<matched: long, unmatched: long, frames: long, peak_buffer_frames: long, peak_buffer_bytes: long>, "
            "video_frames long, options map<string, string>, events array<struct<idx: int, start_frame: long, end_frame: long>>",
        ).alias("r"),
    )
    place = F.transform("r.events", lambda e: F.concat(e["idx"].cast("string"), F.lit(":"), e["start_frame"].cast("string"), F.lit("-"), e["end_frame"].cast("string")))
    return read.select(
        "video_id", "r.stats.*", "r.video_frames", F.col("r.options")["lookahead"].alias("lookahead"), F.md5(F.array_join(place, ",")).alias("events")
    )


# Recordings with what goes wrong in them.  By the number of a line, modulo 4: 0 is short, comes after a pause that the
# script tells of, and shows up too early by mistake; 1 is misread at first, and right only in an alternative; 2 stays on
# screen while 3 is added to it, without a blank frame between them.
_SHOWN = {0: (2, 8), 1: (2, 22), 2: (2, PER_LINE), 3: (0, 22)}
#: Frames of line 4 n - 1 in which line 4 n is shown too early; the pause reaches over them.
_EARLY, _PAUSE = (25, 30), 0.8
SCENE_OPTIONS = Options(confirmations=5)


def scenes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = script(spark, sf_dir).withColumn("video_id", F.col("conv_id").cast("string"))
    slots = lines.select(
        "video_id", "conv_id", "idx", "text", F.explode(F.sequence(F.lit(0), F.lit(PER_LINE - 1))).alias("k"),
        F.lead("text").over(Window.partitionBy("conv_id").orderBy("idx")).alias("next"),
    ).withColumn("frame_index", F.col("idx") * PER_LINE + F.col("k"))
    kind, k = F.col("idx") % 4, F.col("k")
    shown = F.lit(False)
    for number, (first, end) in _SHOWN.items():
        shown = shown | ((kind == number) & (k >= first) & (k < end))
    early = (kind == 3) & (k >= _EARLY[0]) & (k < _EARLY[1]) & F.col("next").isNotNull()
    blank = F.lit(bytes(H * W // 8))
    slots = slots.withColumns({"shown": shown, "early": early})
    # line 3 keeps the mask of line 2 and adds another
    first = F.when(kind == 3, F.col("idx") - 1).otherwise(F.col("idx"))
    added = F.when(kind == 3, 1).otherwise(0)
    frames = slots.select(
        "video_id",
        "frame_index",
        F.lit(H).alias("h"),
        F.lit(W).alias("w"),
        F.when(F.col("shown"), _union_mask(F.col("conv_id"), first, added))
        .when(F.col("early"), _union_mask(F.col("conv_id"), F.col("idx") + 1, F.lit(0)))
        .otherwise(blank)
        .alias("edge"),
    )
    full = F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(W).alias("x1"), F.lit(H).alias("y1"))
    said = F.when(F.col("early"), F.col("next")).otherwise(F.col("text"))
    misread = (kind == 1) & F.col("shown")
    tries = F.array(
        F.struct(F.lit(0).alias("attempt"), F.when(misread, F.lit("qqqqqqqqqqqq")).otherwise(said).alias("text"), F.lit("sample").alias("model")),
        F.struct(F.lit(1).alias("attempt"), F.when(misread, said).alias("text"), F.lit("other").alias("model")),
    )
    readings = (
        slots.where("shown OR early")
        .select("video_id", "frame_index", F.explode(tries).alias("r"))
        .where("r.text IS NOT NULL")
        .select("video_id", "frame_index", "r.attempt", "r.text", F.lit(0.97).alias("confidence"), full.alias("box"), "r.model")
    )
    duration = F.when(kind == 0, 0.5).otherwise(2.0)
    told = F.array_sort(F.collect_list(F.struct("idx", "text", duration.alias("duration"))))
    pauses = F.map_from_entries(
        F.collect_list(F.when((kind == 0) & (F.col("idx") > 0), F.struct(F.col("idx").cast("string"), F.lit(_PAUSE))))
    )
    meta = lines.groupBy("video_id").agg(told.alias("lines"), pauses.alias("gaps")).select(
        "video_id", F.to_json(F.struct(F.lit(FPS).alias("fps"), "lines", "gaps")).alias("meta")
    )
    return frames, readings, meta


def _union_mask(conv: Column, idx: Column, added: Column) -> Column:
    """A pseudo-random 8 x 64 mask of a line, with another mask beside it where ``added`` is 1.

    A row has one pixel in each of the first five bytes, and one in each of the last two if another mask is added.  So
    however the places fall, 40 of the union's 56 pixels are the first mask's and none of the others is near them: they
    score 5/6 against each other, over what a template on screen needs and short of what stands for the same line."""

    def row(k: int) -> Column:
        places = F.xxhash64(conv, idx, F.lit(k))
        at = lambda byte: F.shiftrightunsigned(places, 3 * byte).bitwiseAND(7).cast("int")
        one = lambda byte: F.substring(F.lit("0102040810204080"), 2 * at(byte) + 1, F.lit(2))
        return F.concat(*[one(n) for n in range(5)], F.lit("00"), *[F.when(added == 1, one(n)).otherwise("00") for n in (6, 7)])

    return F.unhex(F.concat(*[row(k) for k in range(H)]))


def _by_kind(values: dict[int, int]) -> str:
    return f"{PER_LINE} * idx + CASE idx % 4 " + " ".join(f"WHEN {n} THEN {v}" for n, v in values.items()) + " END"


@query(
    f"""WITH {SCRIPT_SQL} SELECT CAST(conv_id AS VARCHAR) AS video_id, CAST(idx AS INTEGER) AS idx, 'matched' AS status,
        CAST({_by_kind({n: a for n, (a, _) in _SHOWN.items()})} AS BIGINT) AS start_frame,
        CAST({_by_kind({n: b for n, (_, b) in _SHOWN.items()})} AS BIGINT) AS end_frame,
        CASE WHEN idx % 4 <> 2 THEN 'visual_change' WHEN idx = max(idx) OVER (PARTITION BY conv_id) THEN 'video_end' ELSE 'ocr_transition' END AS end_reason,
        CASE WHEN idx % 4 = 1 THEN 'other' ELSE 'sample' END AS ocr_model
    FROM lines"""
)
def align_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment through pauses, short lines, misreadings and lines that are added to others."""
    found = align(*scenes(spark, sf_dir), SCENE_OPTIONS)
    return found.select("video_id", "idx", "status", "start_frame", "end_frame", "end_reason", "ocr_model")


_CUT = 8


@query(
    f"""WITH {SCRIPT_SQL}, c AS (SELECT conv_id, {PER_LINE} * idx + 2 AS s, {PER_LINE} * idx + 22 AS e, idx FROM lines)
    SELECT CAST(conv_id AS VARCHAR) AS video_id, s AS start_frame, CASE WHEN idx = 0 THEN {_CUT} ELSE e END AS end_frame,
        CASE WHEN idx = 0 THEN 'region_end' ELSE 'visual_change' END AS end_reason, CASE WHEN idx = 0 THEN 'first' ELSE 'second' END AS asset FROM c
    UNION ALL SELECT CAST(conv_id AS VARCHAR), {_CUT}, e, 'visual_change', 'second' FROM c WHERE idx = 0"""
)
def caption_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions in two regions that meet while a caption is on screen; its reading is revised over the same glyphs."""
    frames_, readings_, _ = recordings(spark, sf_dir)
    frames_ = frames_.withColumn("glyphs", F.col("edge"))
    length = frames_.groupBy("video_id").agg(F.count("*").alias("n"))
    region = lambda start, end, asset: F.struct(start.alias("start_frame"), end.alias("end_frame"), F.array(F.lit(asset)).alias("assets"))
    meta = length.select(
        "video_id",
        F.to_json(
            F.struct(
                F.lit(FPS).alias("fps"),
                F.array(region(F.lit(_CUT).cast("long"), F.col("n"), "second"), region(F.lit(0).cast("long"), F.lit(_CUT).cast("long"), "first")).alias("regions"),
            )
        ).alias("meta"),
    )
    found = captions(frames_, readings_, meta, supplement_options(Options()))
    return found.select("video_id", "start_frame", "end_frame", "end_reason", F.col("movie_assets")[0].alias("asset"))


@query(
    f"""WITH RECURSIVE {FRAMES_SQL}, t AS (SELECT user_id, f, event_type FROM frames),
    n AS (SELECT user_id, max(f) + 1 AS n FROM t GROUP BY user_id),
    kinds AS (SELECT unnest(['view', 'click', 'purchase', 'error', 'view']) AS kind, unnest(range(0, 5)) AS line),
    place AS (
        SELECT user_id, CAST(-1 AS BIGINT) AS line, CAST(-1 AS BIGINT) AS start_frame, CAST(0 AS BIGINT) AS end_frame FROM n
        UNION ALL
        SELECT s.user_id, s.line, s.start_frame, coalesce(min(e.f), any_value(s.n)) AS end_frame
        FROM (SELECT p.user_id, k.line, k.kind, n.n, min(t.f) AS start_frame
              FROM place p JOIN kinds k ON k.line = p.line + 1 JOIN n ON n.user_id = p.user_id
              JOIN t ON t.user_id = p.user_id AND t.f >= p.end_frame AND t.event_type = k.kind
              GROUP BY p.user_id, k.line, k.kind, n.n) s
        LEFT JOIN (SELECT user_id, f, event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c
                   FROM t WINDOW w AS (PARTITION BY user_id ORDER BY f)) e
            ON e.user_id = s.user_id AND e.f > s.start_frame AND e.a <> s.kind AND e.b <> s.kind AND e.c <> s.kind
        GROUP BY s.user_id, s.line, s.start_frame
    )
    SELECT user_id, CAST(line AS INTEGER) AS line, start_frame, end_frame FROM place WHERE line >= 0"""
)
def forward_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template mode: five kinds of events are placed one after another on a user's frames."""
    kinds = ["view", "click", "purchase", "error", "view"]
    schema = "user_id long, line int, start_frame long, end_frame long"

    def place(batches):
        """Frames come by user and in order; a task holds one user's last frames."""
        user, placer, found = None, None, []
        for batch in batches:
            for here, kind in zip(batch.column("user_id").to_pylist(), batch.column("event_type").to_pylist(), strict=True):
                if here != user or placer is None:
                    found += [(user, p) for p in placer.close()] if placer is not None else []
                    user, placer = here, LinePlacer(len(kinds))
                found += [(user, p) for p in placer.feed(lambda line, kind=kind: kind == kinds[line])]
            yield _placed_batch(found)
            found = []
        if placer is not None:
            yield _placed_batch([(user, p) for p in placer.close()])

    ordered = event_frames(spark, sf_dir).select("user_id", "f", "event_type").repartition("user_id").sortWithinPartitions("user_id", "f")
    return ordered.mapInArrow(place, schema)


def _placed_batch(found: list) -> pa.RecordBatch:
    columns = [[u for u, _ in found], *([getattr(p, n) for _, p in found] for n in ("index", "start_frame", "end_frame"))]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["user_id", "line", "start_frame", "end_frame"]
    )


@query(
    """WITH m AS (SELECT vec_id, label, list_transform(embedding, lambda x: coalesce(x > 0, false)) AS a,
            lead(list_transform(embedding, lambda x: coalesce(x > 0, false))) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
    p AS (SELECT vec_id, a, b, unnest(range(0, 64)) AS i FROM m WHERE b IS NOT NULL),
    n AS (SELECT vec_id, i, a[i + 1] AS x, b[i + 1] AS y,
            len(list_filter(range(0, 64), lambda j: a[j + 1] AND abs(j // 8 - i // 8) <= 1 AND abs(j % 8 - i % 8) <= 1)) > 0 AS near_a,
            len(list_filter(range(0, 64), lambda j: b[j + 1] AND abs(j // 8 - i // 8) <= 1 AND abs(j % 8 - i % 8) <= 1)) > 0 AS near_b FROM p),
    c AS (SELECT vec_id, count(*) FILTER (x) AS na, count(*) FILTER (y) AS nb,
            count(*) FILTER (x AND near_b)::DOUBLE AS hit_a, count(*) FILTER (y AND near_a)::DOUBLE AS hit_b FROM n GROUP BY vec_id)
    SELECT vec_id, round(CASE WHEN least(na, nb) < 5 THEN 0.0::DOUBLE
        ELSE 2 * (hit_a / na) * (hit_b / nb) / greatest(hit_a / na + hit_b / nb, 1e-9) END, 6) AS overlap FROM c"""
)
def mask_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the sign masks (rows of 8) of vectors that follow each other."""
    bits = F.aggregate("embedding", F.lit(""), lambda a, x: F.concat(a, F.when(x > 0, "1").otherwise("0")))
    size = F.size("embedding")
    masks = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        F.floor(size / 8).cast("int").alias("h"),
        F.unhex(F.lpad(F.conv(bits, 2, 16), F.floor(size / 4).cast("int"), F.lit("0"))).alias("mask"),
    )
    after = masks.withColumn("next", F.lead("mask").over(Window.partitionBy("label").orderBy("vec_id")))
    return after.where("next IS NOT NULL").select(
        "vec_id", F.round(edge_overlap("mask", "next", "h", F.lit(8)), 6).alias("overlap")
    )
