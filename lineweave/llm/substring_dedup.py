"""Substring deduplication by hashing of lines and their sentences.

Texts are cut into units: at line ends, and inside a line after sentence ends and before capitalised
words, where a passage that was pasted into the middle of a line begins.  Units of over LONG words (no
marks, as in lower-case text or unspaced scripts) are cut before words whose hash is divisible by
CONTENT, so equal passages are cut alike wherever they stand.  Units are normalised (lower case, words
only; each character of an unspaced script is a word, and two of them count as one) and hashed to 96
bits; a unit of fewer than SHORT words is hashed together with the one before it, since alone it says
nothing.  Digests are grouped globally, the occurrence of lowest rank (smallest doc_id, then place in
the text) stays, all later ones go.  ``min_words`` spares runs of consecutive later occurrences with
fewer words; off unless given.

``removed`` has the spans of the original text that are gone (white space behind a unit goes with it),
``kept`` those that stay, both in code points: the text is its ``kept`` spans put together.

Defined results: a null text counts as empty; a null id ranks first; rows that repeat both id and
text are one document and get equal results; a text may lose all of its units and is then empty;
very long texts are units like any others; columns besides doc_id and text are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import expect_columns, join_hot, marked_rows, stored, text_or_empty, trimmed

#: What the registered query and the pipeline spare: stock phrases and license lines of clean documents.
SPARED_BELOW = 20
SHORT = 3
LONG = 64
CONTENT = 8
NULL_ID = -(1 << 63)

_SPACE, _CAPITAL, _END, _BREAK, _WIDE = 1, 2, 4, 8, 16
#: What each code point is to the cutting of units.
_KINDS = np.zeros(0x110000, dtype=np.uint8)
for _chars, _kind in (
    ([chr(c) for c in range(0x3001) if chr(c).isspace()], _SPACE),
    ([chr(c) for a, b in ("AZ", "ÀÖ", "ØÞ", "ΑΩ", "АЯ") for c in range(ord(a), ord(b) + 1)], _CAPITAL),
    (".!?", _END),
    ("\n\r", _BREAK),
    ("。！？", _WIDE),
):
    _KINDS[[ord(c) for c in _chars]] |= _kind
# Scripts written without spaces (Thai, Lao, Myanmar, Khmer, kana, ideographs).
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
WORDS = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
_UNSPACED = re.compile(f"[{UNSPACED}]")


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of the units of a text, in order.

    White space ends a unit after a sentence, before a capitalised word (not one in capitals), and with a line end in
    it; a full-width sentence end needs no white space.
    """
    if not text:
        return []
    kinds = _KINDS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    spaces = np.zeros(len(kinds) + 2, dtype=np.int8)
    spaces[1:-1] = kinds & _SPACE
    edges = np.diff(spaces)
    first, behind = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    around = np.zeros(len(kinds) + 3, dtype=np.uint8)
    around[1:-2] = kinds  # character i is around[i + 1]
    breaks = np.zeros(len(kinds) + 1, dtype=np.int64)
    np.cumsum((kinds & _BREAK) > 0, out=breaks[1:])
    capital = ((around[behind + 1] & _CAPITAL) > 0) & ((around[behind + 2] & _CAPITAL) == 0)
    cut = capital | ((around[first] & _END) > 0) | (breaks[behind] > breaks[first])
    first, behind = first[cut], behind[cut]
    wide = np.flatnonzero(kinds & _WIDE) + 1
    if len(wide):
        places = np.concatenate([np.stack([first, behind], 1), np.stack([wide, wide], 1)])
        first, behind = places[np.lexsort((places[:, 1], places[:, 0]))].T
    starts, ends = np.concatenate([[0], behind]), np.concatenate([first, [len(text)]])
    keep = ends > starts
    return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


def _pieces(low: str, start: int, end: int) -> Iterator[tuple[int, int, list[str]]]:
    """A unit with its words; one of over LONG words in pieces that its content alone decides."""
    words = WORDS.findall(low, start, end)
    if len(words) <= LONG:
        yield start, end, words
        return
    at, mine = start, []
    for m in WORDS.finditer(low, start, end):
        if mine and xxhash.xxh32_intdigest(m[0].encode("utf-8", "surrogatepass")) % CONTENT == 0:
            yield at, m.start(), mine
            at, mine = m.start(), []
        mine.append(m[0])
    yield at, end, mine


def _lower(text: str) -> str:
    """Lower case, character by character where that changes the length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c in text for x in (c.lower(),))


def digests(text: str) -> tuple[list[tuple[int, int]], list[bytes], list[int]]:
    """Spans, 96-bit digests and word counts of the units that have words."""
    spans, marks, sizes = [], [], []
    before = ""
    low = _lower(text)
    wide = bool(_UNSPACED.search(low))
    for begin, finish in units(text):
        for start, end, words in _pieces(low, begin, finish):
            if not words:
                continue
            norm = " ".join(words)
            key = norm if len(words) >= SHORT else f"{before}\n{norm}"
            spans.append((start, end))
            marks.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))[:12])
            sizes.append(len(words) if not wide else len(words) - sum(map(bool, map(_UNSPACED.match, words))) // 2)
            before = norm
    return spans, marks, sizes


_UNITS = "doc_id long, text_key long, unit int, digest long, tail int, words int"
#: Units sent on at once.
FLUSH = 100_000


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
        out: list[list] = [[] for _ in range(5)]

        def done(out=out) -> pa.RecordBatch:
            marks = np.frombuffer(b"".join(out[3]), dtype=np.dtype([("digest", "<i8"), ("tail", "<i4")]))
            found = pa.RecordBatch.from_arrays(
                [
                    pa.array(out[0], pa.int64()),
                    pa.array(out[1], pa.int64()),
                    pa.array(out[2], pa.int32()),
                    pa.array(np.ascontiguousarray(marks["digest"])),
                    pa.array(np.ascontiguousarray(marks["tail"])),
                    pa.array(out[4], pa.int32()),
                ],
                names=["doc_id", "text_key", "unit", "digest", "tail", "words"],
            )
            for column in out:
                column.clear()
            return found

        for i, text in enumerate(batch.column("text")):
            _, marks, sizes = digests(text.as_py() or "")
            for at in range(0, len(marks), FLUSH):
                n = len(marks[at : at + FLUSH])
                out[0].extend([ids[i]] * n)
                out[1].extend([keys[i]] * n)
                out[2].extend(range(at, at + n))
                out[3].extend(marks[at : at + n])
                out[4].extend(sizes[at : at + n])
                if len(out[0]) >= FLUSH:
                    yield done()
        yield done()


def cut_out(text: str, repeats: dict[int, int], min_words: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Spans of the runs of repeats that go, and the ids that the repeats have in ``repeats``."""
    spans, _, sizes = digests(text)
    removed, sources = [], set()
    i = 0
    while i < len(spans):
        j = i
        while j < len(spans) and j in repeats:
            j += 1
        if j > i and sum(sizes[i:j]) >= min_words:
            end = spans[j - 1][1]
            while end < len(text) and text[end].isspace():  # the white space behind goes too
                end += 1
            removed.append((spans[i][0], end))
            sources.update(repeats[k] for k in range(i, j))
        i = max(j, i + 1)
    return removed, sorted(sources)


def _others(length: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the spans leave of a text of this length."""
    edges = [0, *[x for span in spans for x in span], length]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b > a]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cutter(min_words: int, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone, kept, sources = [], [], [], []
            for text, repeats in zip(batch.column("text"), batch.column("repeats").to_pylist(), strict=True):
                original = text.as_py()
                whole = original or ""
                found = {r["unit"]: r["source"] for r in repeats or ()}
                cut, ids = cut_out(whole, found, min_words) if found else ([], [])
                stay = _others(len(whole), cut)
                texts.append("".join(whole[a:b] for a, b in stay) if cut else original)
                gone.append([{"start": a, "end": b} for a, b in cut])
                kept.append([{"start": a, "end": b} for a, b in stay])
                sources.append(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in extra],
                    pa.array(texts, pa.string()),
                    pa.array(gone, _SPANS),
                    pa.array(kept, _SPANS),
                    pa.array(sources, pa.list_(pa.int64())),
                ],
                names=[*extra, "text", "removed", "kept", "source_ids"],
            )

    return run


def later_occurrences(rows: DataFrame, min_words: int) -> DataFrame:
    """(_id, _key, repeats) of the texts of ``rows`` (_id, _key, _text) with runs of later occurrences of ``min_words``
    words or more; repeats: (unit, source, words) of each, source being the document of the first occurrence."""
    found = stored(
        rows.select(F.col("_id").alias("doc_id"), F.col("_key").alias("text_key"), F.col("_text").alias("text")).mapInArrow(
            trimmed(_emit), _UNITS
        )
    )
    place = F.struct("doc_id", "text_key", "unit")
    firsts = stored(
        found.groupBy("digest", "tail")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "tail", F.col("first.doc_id").alias("source"), F.col("first.text_key").alias("key"),
                F.col("first.unit").alias("at"), "n")
    )
    later = (
        join_hot(found, firsts, ["digest", "tail"], "n")
        .where((F.col("doc_id") != F.col("source")) | (F.col("text_key") != F.col("key")) | (F.col("unit") != F.col("at")))
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_set(F.struct("unit", "source", F.col("words").cast("long").alias("words")))).alias("repeats"))
    )
    return later.where(_longest_run(F.col("repeats")) >= min_words).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "repeats"
    )


def _longest_run(repeats: Column) -> Column:
    """Most words of consecutive units in an array of (unit, ..., words) in order."""
    zero = F.lit(0).cast("long")

    def step(state: Column, x: Column) -> Column:
        run = x["words"] + F.when(x["unit"] == state["last"] + 1, state["run"]).otherwise(zero)
        return F.struct(x["unit"].alias("last"), run.alias("run"), F.greatest(state["best"], run).alias("best"))

    return F.aggregate(
        repeats, F.struct(F.lit(-2).alias("last"), zero.alias("run"), zero.alias("best")), step, lambda state: state["best"]
    )


def substring_dedup(docs: DataFrame, min_words: int = 1, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the ``keep`` columns (doc_id if none are named), the text that
    stays, ``removed`` and ``kept`` (spans in the original text) and ``source_ids`` (documents that hold what was
    removed)."""
    keep = keep or ["doc_id"]
    rows = docs.select(
        *[docs[c] for c in keep],
        docs["text"].alias("_text"),
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("_key"),
    )
    repeats = stored(later_occurrences(rows, min_words))
    kept_types = [docs.schema[c] for c in keep]
    spans = "array<struct<start: long, end: long>>"
    schema = ", ".join(
        [*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept_types],
         "text string", f"removed {spans}", f"kept {spans}", "source_ids array<long>"]
    )
    # only texts with something to remove move to where their repeats are
    touched, untouched = marked_rows(rows, repeats.select("_key"), "_key")
    cut = (
        touched.join(repeats, ["_id", "_key"], "left")
        .select(*keep, F.col("_text").alias("text"), "repeats")
        .mapInArrow(trimmed(_cutter(min_words, keep)), schema)
    )
    whole = F.struct(F.lit(0).cast("long").alias("start"), F.length("_text").cast("long").alias("end"))
    same = untouched.select(
        *keep,
        F.col("_text").alias("text"),
        F.array().cast(spans).alias("removed"),
        F.filter(F.array(whole), lambda x: x["end"] > 0).alias("kept"),
        F.array().cast("array<long>").alias("source_ids"),
    )
    return cut.unionByName(same)


def substring_report(docs: DataFrame, min_words: int = SPARED_BELOW) -> DataFrame:
    """``substring_dedup`` with counts: doc_id, text, n_removed, removed_chars, removed, kept, source_ids."""
    rows = expect_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return substring_dedup(rows, min_words).select(
        "doc_id",
        "text",
        F.size("removed").cast("long").alias("n_removed"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]).alias("removed_chars"),
        "removed",
        "kept",
        # null ids are ids too
        F.transform("source_ids", lambda i: F.when(i != NULL_ID, i)).alias("source_ids"),
    )
