"""SimHash near-duplicate groups with pigeonring filtering.

Fingerprints are 64 bits over the XXH64 values of 3-word shingles.  Equal fingerprints are one
class; classes link at ``max_bits`` differing bits or fewer.  The 64 bits are a ring of SEGMENTS
segments.  If two fingerprints differ in t bits or fewer, some start exists from which every run
of l consecutive segments has at most l * t / SEGMENTS differences.  The first runs of such a
chain allow no difference at all, so they are the join key; the longer runs prune the candidates
before the full Hamming check.

Candidate buckets of more than BUCKET classes are not paired.  Their classes go an exact linear
way instead: two fingerprints are within two bits exactly if both are within one bit of a common
point, so each is dealt to its 65 points, and a point (which holds 65 classes at most) links its
classes to its smallest one.

``near_text.near_groups`` is the form for a given similarity of texts.

Defined results: a null text counts as empty; no words give fingerprint zero, linked like any
other; null ids keep their rows and never name a component unless all ids of it are null;
repeated rows are rows of one class; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, WINDOW, durable, expect_columns, join_hot, stored, string_bytes, text_or_empty, trimmed
from .components import connected_components, name_components
from .near_text import near_groups

__all__ = ["near_groups", "ring_links", "simhash", "simhash_groups"]

SEED = 42
WORDS = 3
SEGMENTS = 8
MAX_BITS = 2
#: Classes of a candidate bucket that are paired with each other; larger buckets take the linear way.
BUCKET = 48

_SPACE = re.compile(rb"[\x09-\x0d ]")


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    at = 0
    while at < len(data):
        cut = len(data)
        if at + WINDOW < len(data) and (m := _SPACE.search(data, at + WINDOW)):
            cut = m.end()
        yield data[at:cut].translate(LOWER_BYTES).split()
        at = cut


def _bit_counts(words: list[bytes], k: int) -> tuple[np.ndarray, int]:
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    if len(words) < k:
        values = [digest(joined, SEED)]
    else:
        values = [
            digest(joined[s:e], SEED)
            for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
        ]
    bits = np.unpackbits(np.array(values, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64), len(values)


def simhash(data: bytes, k: int = WORDS) -> int:
    """The fingerprint of a UTF-8 text."""
    counts, n, carry = np.zeros(64, dtype=np.int64), 0, []
    for words in _pieces(data):
        words = carry + words
        if len(words) >= k:
            more, m = _bit_counts(words, k)
            counts, n = counts + more, n + m
            carry = words[len(words) - k + 1 :]
        else:
            carry = words
    if not n and carry:
        counts, n = _bit_counts(carry, k)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = string_bytes(batch.column("text"))
        data = memoryview(np.ascontiguousarray(buf))
        found = [simhash(bytes(data[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(np.array(found, dtype=np.uint64).view(np.int64))],
            names=["doc_id", "text_key", "fp"],
        )


def _rotated(fp: Column, segment: int) -> Column:
    bits = segment * (64 // SEGMENTS)
    if not bits:
        return fp
    return F.shiftrightunsigned(fp, bits).bitwiseOR(F.shiftleft(fp, 64 - bits))


def _low_mask(bits: int) -> int:
    return (1 << bits) - 1 if bits < 64 else -1


def ring_links(classes: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join all classes (column fp, distinct) within ``max_bits``, directly or by a chain."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2: the way for large buckets is exact up to two bits")
    width = 64 // SEGMENTS
    budget = [run * max_bits // SEGMENTS for run in range(SEGMENTS + 1)]
    exact = max(run for run in range(SEGMENTS + 1) if not budget[run])
    turned = F.explode(
        F.array(*[F.struct(F.lit(s).alias("s"), _rotated(F.col("fp"), s).alias("r")) for s in range(SEGMENTS)])
    )
    keys = classes.select("fp", turned.alias("x")).select(
        "fp", F.col("x.s").alias("s"), F.col("x.r").alias("r"), F.col("x.r").bitwiseAND(_low_mask(exact * width)).alias("k")
    )
    large = durable(keys.groupBy("s", "k").count().where(F.col("count") > bucket).select("s", "k"))
    small = keys.join(large, ["s", "k"], "left_anti")
    differ = F.col("x.r").bitwiseXOR(F.col("y.r"))
    chain = [
        F.bit_count(differ.bitwiseAND(F.lit(_low_mask(run * width)))) <= budget[run]
        for run in range(exact + 1, SEGMENTS + 1)
        if run == SEGMENTS or budget[run] != budget[run + 1]
    ]
    on = (F.col("x.s") == F.col("y.s")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.fp") < F.col("y.fp"))
    for test in chain:
        on = on & test
    near = small.alias("x").join(small.alias("y"), on).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    crowded = keys.join(large, ["s", "k"], "left_semi").select("fp").distinct()
    points = F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)]))
    reach = [0, 0, 1][max_bits]
    if not reach:  # one bit or none: the other end itself is the point
        hubs = (
            crowded.select("fp", (points if max_bits else F.col("fp")).alias("point"))
            .join(crowded.withColumnRenamed("fp", "point"), "point", "left_semi")
            .select(F.col("fp").alias("a"), F.col("point").alias("b"))
        )
    else:
        hubs = (
            crowded.select("fp", points.alias("point"))
            .groupBy("point")
            .agg(F.collect_list("fp").alias("l"))
            .where(F.size("l") > 1)
            .select(F.explode("l").alias("a"), F.array_min("l").alias("b"))
        )
    return near.unionByName(hubs.where("a <> b"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def simhash_groups(docs: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): fingerprint (16 hex digits), component_id and
    text_key (xxhash64 of the text)."""
    rows = expect_columns(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_key"), "text"
    )
    signed = durable(rows.mapInArrow(trimmed(_sign), "doc_id long, text_key long, fp long"))
    classes = stored(signed.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    linked = connected_components(ring_links(classes.select("fp"), max_bits, bucket))
    named = name_components(linked, classes.withColumnRenamed("fp", "node"), "first").withColumnRenamed("node", "fp")
    labels = stored(
        classes.join(named, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"), "n")
    )
    return join_hot(signed, labels, ["fp"], "n").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_key"
    )
