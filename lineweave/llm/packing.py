"""Packing into optimal length buckets.

Texts are encoded by byte-level BPE and their ids cut into pieces of at most ``max_tokens``.  (The ids are those of
``bpe.py``; here a library makes them, three times as fast, as how texts are encoded is not this operator's matter.)  The lengths of all pieces make a histogram of that many bins.  Dynamic programming over
it chooses the bucket boundaries that minimise the padding, sum over pieces of (boundary - length).
Inside a bucket, pieces are dealt into batches of ``token_budget // boundary`` pieces (one at least).

A piece's place in its bucket is the number of pieces before it: buckets are dealt into shards by
a hash, the shards' sizes (a table of buckets times shards) give the offsets, and pieces are
numbered inside their shard, so no task holds a bucket and the pieces of a batch come to stand together.

``ids`` holds the token ids of a piece as little-endian unsigned 32-bit integers.  Without a tokenizer,
``length`` measures texts (white-space words if it is not given) and there are no ids.

Defined results: a null or empty text has no tokens and one piece of length 0, in the first bucket;
very long texts are many pieces; repeated rows are pieces each; null ids keep their rows; columns besides
doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import expect_columns, stored, trimmed

MAX_TOKENS = 2048
BUCKETS = 16
TOKEN_BUDGET = 16384
#: Pieces of a shard, on average.
SHARD = 20_000


@dataclass(frozen=True)
class Plan:
    boundaries: list[int]
    padding: int


def word_count(text: Column) -> Column:
    """Words separated by ASCII white space, the measure of length unless another is given."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def plan_buckets(histogram: dict[int, int], buckets: int) -> Plan:
    """At most ``buckets`` boundaries of least padding for {length: count}; among equals those that DP meets first."""
    lengths = np.array(sorted(n for n, c in histogram.items() if c > 0), dtype=np.int64)
    m = len(lengths)
    if not m:
        return Plan([], 0)
    counts = np.array([histogram[n] for n in lengths.tolist()], dtype=np.float64)
    before = np.concatenate([[0.0], np.cumsum(counts)])
    mass = np.concatenate([[0.0], np.cumsum(counts * lengths)])
    buckets = min(buckets, m)
    cost = np.full(m + 1, np.inf)
    cost[0] = 0.0
    choice = np.zeros((buckets, m + 1), dtype=np.int64)
    for b in range(buckets):
        fresh = np.full(m + 1, np.inf)
        for j in range(1, m + 1):
            # the bucket holds lengths i .. j-1 and pads to lengths[j - 1]
            total = cost[:j] + lengths[j - 1] * (before[j] - before[:j]) - (mass[j] - mass[:j])
            i = int(total.argmin())
            fresh[j], choice[b, j] = total[i], i
        if b == 0:
            fresh[0] = 0.0
        cost = fresh
    boundaries, j = [], m
    for b in range(buckets - 1, -1, -1):
        if not j:
            break
        boundaries.append(int(lengths[j - 1]))
        j = int(choice[b, j])
    return Plan(boundaries[::-1], int(round(cost[m])))


def word_pieces(docs: DataFrame, length: Column | None, max_tokens: int) -> DataFrame:
    """(doc_id, mark, piece, n_tokens) of texts that are measured, not encoded."""
    measured = expect_columns(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (length if length is not None else word_count(F.col("text"))).cast("long").alias("total"),
        F.xxhash64("text").alias("mark"),
    )
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / max_tokens))
    return measured.select("doc_id", "total", "mark", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "doc_id",
        "mark",
        F.col("piece").cast("int").alias("piece"),
        F.least(F.lit(max_tokens).cast("long"), F.col("total") - F.col("piece") * max_tokens).alias("n_tokens"),
    )


#: Bytes of ids that are sent on at once.
FLUSH = 8 << 20

_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """One per worker, without special tokens."""
    if (path, pattern) not in _encodings:
        _encodings[path, pattern] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _encodings[path, pattern]


def token_pieces(docs: DataFrame, path: str, pattern: str, max_tokens: int) -> DataFrame:
    """(doc_id, mark, piece, n_tokens, ids) of the encoded texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, pattern).encode_to_numpy
        step = 4 * max_tokens
        out: list[tuple[int | None, int, int, int, bytes]] = []
        size = 0

        def done() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            found = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(found, names=["doc_id", "mark", "piece", "n_tokens", "ids"])

        for batch in batches:
            keys = zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), strict=True)
            for (doc_id, mark), text in zip(keys, batch.column("text"), strict=True):
                ids = encode(text.as_py() or "").astype("<u4").tobytes()
                for piece, at in enumerate(range(0, max(len(ids), 1), step)):
                    part = ids[at : at + step]
                    out.append((doc_id, mark, piece, len(part) // 4, part))
                size += len(ids)
                if size > FLUSH:
                    yield done()
                    size = 0
            if out:
                yield done()
                size = 0

    rows = expect_columns(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text"
    )
    return rows.mapInArrow(trimmed(run), "doc_id long, mark long, piece int, n_tokens long, ids binary")


def pack(
    docs: DataFrame,
    tokenizer: tuple[str, str] | None = None,
    length: Column | None = None,
    max_tokens: int = MAX_TOKENS,
    buckets: int = BUCKETS,
    token_budget: int = TOKEN_BUDGET,
) -> DataFrame:
    """One row per piece: doc_id, piece, first_token, n_tokens, bucket, bucket_tokens, batch, slot, padding and ids.

    ``tokenizer`` is a file of ranks that every machine can read, and the pattern that cuts texts.
    """
    pieces = stored(
        token_pieces(docs, *tokenizer, max_tokens) if tokenizer is not None else word_pieces(docs, length, max_tokens)
    )
    # max_tokens + 1 rows at most
    histogram = {r[0]: r[1] for r in pieces.groupBy("n_tokens").count().collect()}
    plan = plan_buckets(histogram, buckets)
    if not plan.boundaries:
        plan = Plan([max_tokens], 0)
    bounds = F.array(*[F.lit(b).cast("long") for b in plan.boundaries])
    shards = max(1, -(-sum(histogram.values()) // SHARD))
    bucket = F.size(F.filter(bounds, lambda b: b < F.col("n_tokens")))
    dealt = pieces.withColumn("bucket", bucket).select(
        "*", F.pmod(F.xxhash64("doc_id", "mark", "piece"), F.lit(shards)).cast("int").alias("shard")
    )
    sizes = dealt.groupBy("bucket", "shard").count()
    offsets = sizes.select(
        "bucket",
        "shard",
        (
            F.sum("count").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
            - F.col("count")
        ).alias("offset"),
    )
    inside = Window.partitionBy("bucket", "shard").orderBy("doc_id", "mark", "piece")
    placed = dealt.withColumn("n", F.row_number().over(inside) - 1).join(offsets, ["bucket", "shard"])
    size = F.get(bounds, F.col("bucket"))
    capacity = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest(size, F.lit(1).cast("long"))))
    return (
        placed.withColumn("bucket_tokens", size)
        .withColumn("at", F.col("offset") + F.col("n"))
        .select(
            "doc_id",
            "piece",
            (F.col("piece").cast("long") * max_tokens).alias("first_token"),
            "n_tokens",
            "bucket",
            "bucket_tokens",
            F.floor(F.col("at") / capacity).alias("batch"),
            (F.col("at") % capacity).cast("int").alias("slot"),
            (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
            *(["ids"] if tokenizer is not None else []),
        )
    )
