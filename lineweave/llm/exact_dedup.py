"""Exact deduplication by composable polynomial fingerprints.

A text is a sequence of chunks.  Each chunk has a polynomial hash modulo two primes, and hashes
combine by length-shifted arithmetic, ``h(a + b) = h(a) * r**len(b) + h(b)``, so the chunks of a
huge text can be hashed side by side, in any grouping.  Rows with equal fingerprints and lengths
are then compared chunk by chunk against one row of their group, in sorted streams of at most PER_SALT
rows; rows that differ after all (a collision) are told apart by their SHA-256.  Only texts whose key
(a hash, looked up in a Bloom filter) occurs more than once move at all, and rows that repeat an id and
a text are compared where they stand, so that each is chunked once.

Defined results: a null text counts as empty; a null id sorts below all others; rows that repeat
both id and text are one document and all of them carry the same values (``kept`` included);
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, expect_columns, join_hot, marked_rows, row_windows, stored, string_bytes, text_or_empty, trimmed

#: The two largest primes under 2**31 and a base for each (fixed values).
PRIMES = (2147483647, 2147483629)
BASES = (1402024253, 715225741)
CHUNK = 1 << 16
#: Rows of one group that are compared against one copy of its first row's chunks.
PER_SALT = 128
NULL_ID = -(1 << 63)
#: Bytes of texts that a task keeps to know rows that repeat an id and a text.
HELD_BYTES = 32 << 20

_POW = []
for _p, _r in zip(PRIMES, BASES, strict=True):
    _t = np.empty(CHUNK, dtype=np.int64)
    _v = 1
    for _i in range(CHUNK):
        _t[_i] = _v
        _v = _v * _r % _p
    _POW.append(_t)


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """The hash (h1, h2, length) of two texts put together, from theirs."""
    shifted = (
        (l * pow(r, right[2], p) + h) % p for l, h, r, p in zip(left[:2], right[:2], BASES, PRIMES, strict=True)
    )
    return (*shifted, left[2] + right[2])


def fingerprints(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """62-bit fingerprints of the rows buf[offsets[i]:offsets[i + 1]]."""
    lengths = np.diff(offsets)
    per_row = -(-lengths // CHUNK)
    row = np.repeat(np.arange(len(lengths)), per_row)
    number = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    begin = offsets[:-1][row] + number * CHUNK
    size = np.minimum(CHUNK, offsets[1:][row] - begin)
    hashes = np.zeros((2, len(row)), dtype=np.int64)
    if len(row):
        back = np.repeat(begin + size, size) - 1 - np.arange(offsets[0], offsets[-1])
        values = buf[offsets[0] : offsets[-1]].astype(np.int64) + 1
        for k in range(2):
            hashes[k] = np.add.reduceat(values * _POW[k][back], begin - offsets[0]) % PRIMES[k]
    out = np.zeros((2, len(lengths)), dtype=np.int64)
    single = per_row == 1
    out[:, single] = hashes[:, number == 0][:, single[per_row > 0]]
    first = np.cumsum(per_row) - per_row
    for i in np.flatnonzero(per_row > 1):
        whole = (0, 0, 0)
        for j in range(first[i], first[i] + per_row[i]):
            whole = combine(whole, (int(hashes[0, j]), int(hashes[1, j]), int(size[j])))
        out[:, i] = whole[:2]
    return (out[0] << 31) | out[1]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = string_bytes(batch.column("text"))
        view = memoryview(np.ascontiguousarray(buf))
        marks = [fingerprints(buf, offsets[a : b + 1]) for a, b in row_windows(offsets)]
        digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_key"),
                pa.array(np.concatenate(marks) if marks else np.zeros(0, np.int64)),
                pa.array(np.diff(offsets)),
                pa.array(digests, pa.binary()),
            ],
            names=["doc_id", "text_key", "fp", "n_bytes", "sha"],
        )


_CHUNK_SCHEMA = pa.schema(
    [
        ("fp", pa.int64()),
        ("n_bytes", pa.int64()),
        ("salt", pa.int32()),
        ("chunk_no", pa.int32()),
        ("other", pa.bool_()),
        ("doc_id", pa.int64()),
        ("text_key", pa.int64()),
        ("chunk", pa.binary()),
    ]
)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without those that repeat both id and text of one that was met a short while ago."""
    held: OrderedDict[tuple[int, int], bytes] = OrderedDict()
    size = 0
    for batch in batches:
        buf, offsets = string_bytes(batch.column("text"))
        view = memoryview(np.ascontiguousarray(buf))
        stay = []
        keys = zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), strict=True)
        for i, key in enumerate(keys):
            text = view[int(offsets[i]) : int(offsets[i + 1])]
            if key in held and held[key] == text:
                held.move_to_end(key)
                continue
            stay.append(i)
            if key not in held and len(text) <= HELD_BYTES:
                held[key] = bytes(text)
                size += len(text)
                while size > HELD_BYTES:
                    size -= len(held.popitem(last=False)[1])
        yield batch.take(pa.array(stay, pa.int64()))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk; those of a group's lead once for every PER_SALT rows of the group."""
    out: list[tuple] = []
    size = 0
    led: set[tuple[int, int]] = set()
    for batch in _once(batches):
        cols = [batch.column(c).to_pylist() for c in ("fp", "n_bytes", "doc_id", "text_key", "lead", "lead_key", "group_size")]
        buf, offsets = string_bytes(batch.column("text"))
        view = memoryview(np.ascontiguousarray(buf))
        for i, (fp, n, doc_id, key, lead, lead_key, group) in enumerate(zip(*cols, strict=True)):
            salts = -(-group // PER_SALT)
            leads = (doc_id, key) == (lead, lead_key) and (fp, n) not in led
            if leads:
                led.add((fp, n))
            mine = range(salts) if leads else [((doc_id ^ key) ^ (key >> 17)) % salts]
            for number, at in enumerate(range(int(offsets[i]), int(offsets[i + 1]), CHUNK)):
                piece = bytes(view[at : min(at + CHUNK, int(offsets[i + 1]))])
                for salt in mine:
                    out.append((fp, n, salt, number, not leads, doc_id, key, piece))
                    size += len(piece)
                    if size >= 4 << 20:
                        yield _chunk_batch(out)
                        out, size = [], 0
    if out:
        yield _chunk_batch(out)


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CHUNK_SCHEMA.types, strict=True)], schema=_CHUNK_SCHEMA
    )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted with a group's first row leading; gives the rows that differ from it."""
    key, lead = None, b""
    for batch in batches:
        found = []
        cols = [batch.column(c).to_pylist() for c in ("fp", "n_bytes", "salt", "chunk_no", "other", "doc_id", "text_key")]
        for i, (*here, other, doc_id, text_key) in enumerate(zip(*cols, strict=True)):
            piece = batch.column("chunk")[i].as_buffer()
            if here != key:
                key, lead = here, piece if not other else b""
            if memoryview(piece) != memoryview(lead):
                found.append((doc_id, text_key))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["doc_id", "text_key"]
        )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): keep_id, group_size, kept, text_sha256, fp, n_bytes
    and text_key (xxhash64 of the text).
    """
    rows = expect_columns(docs, "doc_id", "text").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        text_or_empty().alias("text"),
        F.xxhash64(text_or_empty()).alias("text_key"),
    )
    signed = durable(
        rows.mapInArrow(trimmed(_sign), "doc_id long, text_key long, fp long, n_bytes long, sha binary")
    )
    groups = (
        signed.groupBy("fp", "n_bytes")
        .agg(F.max(F.struct("doc_id", "text_key")).alias("l"), F.count("*").alias("group_size"))
        .where((F.col("group_size") > 1) & (F.col("n_bytes") > 0))
        .select("fp", "n_bytes", F.col("l.doc_id").alias("lead"), F.col("l.text_key").alias("lead_key"), "group_size")
    )
    members = stored(
        join_hot(signed, stored(groups), ["fp", "n_bytes"], "group_size")
        .groupBy("doc_id", "text_key")
        .agg(*[F.first(c).alias(c) for c in ("fp", "n_bytes", "lead", "lead_key", "group_size")])
    )
    several, _ = marked_rows(rows, members.select("text_key"), "text_key")
    pieces = (
        several.mapInArrow(trimmed(_once), "doc_id long, text string, text_key long")
        .join(members, ["doc_id", "text_key"])
        .repartition("doc_id", "text_key")
        .mapInArrow(
            trimmed(_chunks),
            "fp long, n_bytes long, salt int, chunk_no int, other boolean, doc_id long, text_key long, chunk binary",
        )
    )
    place = ["fp", "n_bytes", "salt", "chunk_no"]
    differing = stored(
        pieces.repartition(*place)
        .sortWithinPartitions(*place, "other")
        .mapInArrow(_compare, "doc_id long, text_key long")
        .distinct()
    )
    none = F.lit(b"")
    if differing.isEmpty():
        settled = signed.withColumn("apart", none)
    else:
        settled = durable(
            signed.join(differing.withColumn("differs", F.lit(True)), ["doc_id", "text_key"], "left")
            .withColumn("apart", F.when(F.col("differs"), F.col("sha")).otherwise(none))
            .drop("differs")
        )
    same = ["fp", "n_bytes", "apart"]
    result = stored(settled.groupBy(*same).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return join_hot(settled, result, same, "group_size").select(
        real("doc_id").alias("doc_id"),
        real("keep_id").alias("keep_id"),
        "group_size",
        (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "fp",
        "n_bytes",
        "text_key",
    )
