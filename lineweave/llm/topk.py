"""Exact top-k search by tiled matrix products.

Vectors are packed into blocks (matrices).  Queries are dealt into groups of about QUERY_BLOCKS blocks and candidates
into groups of shard blocks, and a task takes one of each: it holds its queries, streams through its shards, and for
every tile (its queries times one shard block) keeps the k best per query by partial selection and merges them into
its lists.  The tasks' lists are merged in two steps of a tree: within bunches of groups, then across.  So the
candidates are copied once for each query group, the queries once for each candidate group, of which there are no more
than it takes to give all cores work, and a task hands on k rows for a query, however many shards it saw.

Products are exact: floating point where every sum fits 53 bits, 64-bit integers where it fits
63, Python integers otherwise (scores beyond 64 bits are held at the ends of that range).

Defined results: vectors that are null, empty or hold null or non-finite components take no part;
only vectors of equal length are compared; a null id takes no part.  Rows that repeat an id
and vector are candidates each, and one query; an id with different vectors is a query for each
of them; no row with the query's own id is its candidate.  Ties go to the smaller id; other columns are ignored.  An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import expect_columns, stored

SCALE = 1024
QUERY_BLOCK = 512
SHARD_BLOCK = 2048
#: Query blocks of a group, on average: what a task holds.
QUERY_BLOCKS = 8
_I63 = 1 << 63
#: What stands for no candidate in a list.
_NONE, _NO_ID = -_I63, _I63 - 1

_BLOCK = "dim int, block long, n int, ids binary, marks binary, matrix binary"


def _packer(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def emit(dim: int) -> pa.RecordBatch:
            ids, marks, rows = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            order = np.lexsort((marks, ids))  # places in a block are in the order of ids
            parts = [order[i : i + size] for i in range(0, len(order), size)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([dim] * len(parts), pa.int32()),
                    pa.array([int(ids[p[0]]) for p in parts], pa.int64()),
                    pa.array([len(p) for p in parts], pa.int32()),
                    pa.array([ids[p].tobytes() for p in parts], pa.binary()),
                    pa.array([marks[p].tobytes() for p in parts], pa.binary()),
                    pa.array([rows[p].tobytes() for p in parts], pa.binary()),
                ],
                names=["dim", "block", "n", "ids", "marks", "matrix"],
            )

        for batch in batches:
            lists = batch.column("embedding").cast(pa.large_list(pa.float64()))
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)  # null is NaN
            begin = np.cumsum(lengths) - lengths
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            good = (lengths > 0) & (bad[begin + lengths] == bad[begin])
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            marks = batch.column("mark").to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[good]).tolist():
                mine = np.flatnonzero(good & (lengths == dim))
                rows = flat[begin[mine][:, None] + np.arange(dim)]
                held.setdefault(dim, []).append((ids[mine].astype(np.int64), marks[mine].astype(np.int64), rows))
                if sum(len(x[0]) for x in held[dim]) >= size:
                    yield emit(dim)
        for dim in list(held):
            yield emit(dim)

    return pack


def scaled(matrix: np.ndarray) -> np.ndarray:
    """floor(SCALE * x); infinite where that is too large for a double."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * matrix)


def whole_numbers(matrix: np.ndarray) -> list[list[int]]:
    """floor(SCALE * x) as integers of any size."""
    return [[math.floor(SCALE * x) if abs(x) < 1e300 else SCALE * int(x) for x in row] for row in matrix.tolist()]


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Integer inner products of the scaled rows of two matrices, exactly."""
    a, b = scaled(queries), scaled(shard)
    largest = [float(np.abs(m).max(initial=0)) for m in (a, b)]
    bound = int(largest[0]) * int(largest[1]) * max(1, a.shape[1]) if np.isfinite(largest).all() else _I63
    if bound < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if bound < _I63 and max(largest) < 2.0**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = whole_numbers(queries), whole_numbers(shard)
    return np.array(
        [[max(-_I63 + 1, min(_I63 - 1, sum(map(int.__mul__, q, v)))) for v in whole[1]] for q in whole[0]],
        dtype=np.int64,
    ).reshape(len(queries), len(shard))


def best_of_tile(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores of each row, ties to smaller columns; ``own`` is left out."""
    n = scores.shape[1]
    if n and np.abs(scores).max(initial=0) < (1 << 61) // n:
        key = scores * n + (n - 1 - np.arange(n))
        key[own] = -_I63
        kth = max(0, n - k)
        columns = np.argpartition(key, kth, axis=1)[:, kth:] if kth else np.broadcast_to(np.arange(n), key.shape)
    else:
        order = [sorted(range(n), key=lambda j, s=s, o=o: (bool(o[j]), -int(s[j]), j))[:k] for s, o in zip(scores, own, strict=True)]
        columns = np.array(order, dtype=np.int64).reshape(len(scores), -1)
    rows = np.repeat(np.arange(len(scores)), columns.shape[1])
    columns = columns.ravel()
    keep = ~own[rows, columns]
    return rows[keep], columns[keep]


class Lists:
    """The k best candidates so far of some queries."""

    def __init__(self, blocks: list[dict], k: int) -> None:
        matrices = [np.frombuffer(x["matrix"], dtype=np.float64).reshape(-1, x["dim"]) for x in blocks]
        self.queries = np.concatenate(matrices)
        self.ids, self.marks = (np.concatenate([np.frombuffer(x[c], dtype=np.int64) for x in blocks]) for c in ("ids", "marks"))
        self.k = k
        self.scores = np.full((len(self.ids), k), _NONE, dtype=np.int64)
        self.found = np.full((len(self.ids), k), _NO_ID, dtype=np.int64)

    def see(self, shard: dict) -> None:
        """One tile."""
        vectors = np.frombuffer(shard["matrix"], dtype=np.float64).reshape(-1, shard["dim"])
        ids = np.frombuffer(shard["ids"], dtype=np.int64)
        for at in range(0, len(self.ids), QUERY_BLOCK):
            here = slice(at, at + QUERY_BLOCK)
            scores = products(self.queries[here], vectors)
            r, c = best_of_tile(scores, self.ids[here, None] == ids[None, :], self.k)
            place = np.arange(len(r)) - np.searchsorted(r, r)
            both = [np.concatenate([old[here], np.full_like(old[here], none)], axis=1) for old, none in ((self.scores, _NONE), (self.found, _NO_ID))]
            both[0][r, self.k + place], both[1][r, self.k + place] = scores[r, c], ids[c]
            # largest score first, then smallest id; ~x turns the order of integers round without overflow
            order = np.lexsort((both[1], ~both[0]), axis=1)[:, : self.k]
            self.scores[here], self.found[here] = (np.take_along_axis(x, order, axis=1) for x in both)

    def rows(self, bunch: int) -> pa.RecordBatch:
        r, c = np.nonzero(self.scores != _NONE)
        columns = [self.ids[r], self.marks[r], self.found[r, c], self.scores[r, c], np.full(len(r), bunch, dtype=np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query_id", "mark", "vec_id", "score", "bunch"])


def _search(k: int):
    """Rows come sorted by dimension and groups, queries before shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks, lists = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                here = (row["dim"], row["query_group"], row["shard_group"])
                if here != key:
                    if lists is not None:
                        yield lists.rows(key[2] % BUNCHES)
                    key, blocks, lists = here, [], None
                if not row["shard"]:
                    blocks.append(row)
                elif blocks:
                    lists = lists or Lists(blocks, k)
                    lists.see(row)
        if lists is not None:
            yield lists.rows(key[2] % BUNCHES)

    return run


#: Lists of a query that meet in the first step of the tree, as a number of bunches.
BUNCHES = 64


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """The k candidates (vec_id, embedding) of highest integer inner product for each query (vec_id, embedding)."""
    spark = queries.sparkSession
    mark = lambda df: expect_columns(df, "vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.xxhash64("embedding").alias("mark")
    )
    asked = stored(mark(queries).dropDuplicates(["vec_id", "mark"]).mapInArrow(_packer(QUERY_BLOCK), _BLOCK))
    shards = stored(mark(candidates).mapInArrow(_packer(SHARD_BLOCK), _BLOCK))
    n_queries, n_shards = asked.count(), shards.count()
    query_groups = max(1, -(-n_queries // QUERY_BLOCKS))
    # as many pairs of groups as keep all cores busy
    tasks = 2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shard_groups = max(1, min(n_shards, -(-tasks // query_groups)))
    deal = lambda n: F.pmod(F.xxhash64("ids", "marks"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = (
        asked.withColumn("shard", F.lit(False)).withColumn("query_group", deal(query_groups)).withColumn("shard_group", each(shard_groups))
    ).unionByName(
        shards.withColumn("shard", F.lit(True)).withColumn("shard_group", deal(shard_groups)).withColumn("query_group", each(query_groups))
    )
    place = ["dim", "query_group", "shard_group"]
    lists = (
        both.repartition(query_groups * shard_groups, *place)
        .sortWithinPartitions(*place, "shard")
        .mapInArrow(_search(k), "query_id long, mark long, vec_id long, score long, bunch int")
    )
    for keys in (["query_id", "mark", "bunch"], ["query_id", "mark"]):
        best = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
