"""Window idioms over ordered frames of a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous(column: str, key: str, order: str) -> Column:
    return F.lag(column).over(Window.partitionBy(key).orderBy(order))


def stable_run(frames: DataFrame, changed: Column, key: str, order: str) -> DataFrame:
    """``stable``: frames since the last change, 0 on it."""
    in_order = Window.partitionBy(key).orderBy(order)
    island = F.sum(F.when(changed, 1).otherwise(0)).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    marked = frames.withColumn("_island", island).withColumn("_changed", changed)
    place = F.row_number().over(Window.partitionBy(key, "_island").orderBy(order))
    return marked.withColumn(
        # the run before the first change has no changed frame to start from
        "stable", F.when(F.col("_island") == 0, place).otherwise(place - 1)
    ).drop("_island", "_changed")


def hysteresis_end(frames: DataFrame, k: int, key: str, order: str, hit: str = "hit") -> DataFrame:
    """(key, end): the first of the first k misses in a row; without such, the first miss of the closing run of
    misses, else one past the last frame."""
    in_order = Window.partitionBy(key).orderBy(order)
    missed = F.when(F.col(hit), 0).otherwise(1)
    ahead = frames.withColumn("_misses", F.sum(missed).over(in_order.rowsBetween(0, k - 1)))
    ends = ahead.groupBy(key).agg(
        F.min(F.when(F.col("_misses") == k, F.col(order))).alias("_k"),
        F.max(F.when(F.col(hit), F.col(order))).alias("_last_hit"),
        F.max(order).alias("_last"),
        F.min(order).alias("_first"),
    )
    closing = F.coalesce(F.col("_last_hit") + 1, F.col("_first"))
    return ends.select(key, F.coalesce("_k", closing).alias("end"))


def episodes(frames: DataFrame, k: int, key: str, order: str, hit: str = "hit") -> DataFrame:
    """(key, first, last, hits): runs of hits that k misses in a row separate."""
    hits = frames.where(F.col(hit)).select(key, order)
    in_order = Window.partitionBy(key).orderBy(order)
    apart = F.col(order) - F.lag(order).over(in_order) > k
    numbered = hits.withColumn("_fresh", F.when(apart, 1).otherwise(0)).withColumn(
        "_run", F.sum("_fresh").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(key, "_run").agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("hits")
    ).drop("_run")


def buffer_size(frames: DataFrame, micros: str, span_micros: int, limit: int, key: str) -> DataFrame:
    """``held``: frames that a buffer bounded by age and by count holds at each frame."""
    aged = Window.partitionBy(key).orderBy(micros).rangeBetween(-span_micros, 0)
    return frames.withColumn("held", F.least(F.count("*").over(aged), F.lit(limit)))


def greedy_throttle(frames: DataFrame, micros: str, interval_micros: int, key: str) -> DataFrame:
    """(key, micros) of the frames that act: the first, and each one ``interval_micros`` or more after the last that did.

    What is due depends on what acted before, so a task passes through its keys' times in order, holding the last time
    that acted.
    """
    schema = frames.select(key, F.col(micros).cast("long").alias(micros)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, None
        for batch in batches:
            keys, times = batch.column(0), batch.column(1).to_numpy()
            places: list[int] = []
            changes = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False) if len(keys) > 1 else np.zeros(0, bool)
            edges = [0, *(np.flatnonzero(changes) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                here = keys[a].as_py()
                if here != last_key:
                    last_key, last = here, None
                at = a if last is None else a + int(np.searchsorted(times[a:b], last + interval_micros))
                while at < b:
                    places.append(at)
                    last = int(times[at])
                    at = a + int(np.searchsorted(times[a:b], last + interval_micros))
            yield batch.take(pa.array(places, pa.int64()))

    ordered = frames.where(F.col(key).isNotNull() & F.col(micros).isNotNull()).select(key, F.col(micros).cast("long").alias(micros))
    return ordered.repartition(key).sortWithinPartitions(key, micros).mapInArrow(run, schema)


def confirmations(
    readings: DataFrame, n: int, gap_micros: int, key: str, order: str, micros: str, candidate: str
) -> DataFrame:
    """Readings that are the n-th in a row with one candidate, each ``gap_micros`` at most after the one before.

    A null candidate (a rejected reading) breaks the run.
    """
    in_order = Window.partitionBy(key).orderBy(order)
    same = F.lag(candidate).over(in_order).eqNullSafe(F.col(candidate)) & F.col(candidate).isNotNull()
    near = F.col(micros) - F.lag(micros).over(in_order) <= gap_micros
    runs = readings.withColumn("_fresh", F.when(same & near, 0).otherwise(1)).withColumn(
        "_run", F.sum("_fresh").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    )
    place = F.row_number().over(Window.partitionBy(key, "_run").orderBy(order))
    return (
        runs.withColumn("_place", place)
        .where((F.col("_place") == n) & F.col(candidate).isNotNull())
        .drop("_fresh", "_run", "_place")
    )


def backward_onset(frames: DataFrame, anchors: DataFrame, k: int, key: str, order: str, hit: str = "hit") -> DataFrame:
    """(key, anchor, onset): walking back from each anchor, the earliest hit before k misses in a row.

    That is the first hit of the run of hits (with fewer than k misses between them) that the anchor is in or close
    behind, so one pass over a key's frames and anchors finds all; without such a run the anchor is its own onset.
    """
    seen = F.coalesce(F.col(hit), F.lit(False))
    both = frames.select(key, F.col(order).alias("_at"), seen.alias("_hit"), F.lit(0).alias("_anchor")).unionByName(
        # a walk begins with the frame at its anchor, so anchors come behind it
        anchors.select(key, F.col("anchor").alias("_at"), F.lit(False).alias("_hit"), F.lit(1).alias("_anchor"))
    )
    along = Window.partitionBy(key).orderBy("_at", "_anchor")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    numbered = both.withColumn("_n", F.sum(1 - F.col("_anchor")).over(so_far))
    numbered = numbered.withColumn("_hit_n", F.when(F.col("_hit"), F.col("_n")))
    before = F.max("_hit_n").over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("_hit") & F.coalesce(F.col("_n") - before > k, F.lit(True))
    runs = numbered.withColumn("_start", F.when(fresh, F.col("_at"))).withColumns(
        {"_run": F.last("_start", ignorenulls=True).over(so_far), "_last": F.max("_hit_n").over(so_far)}
    )
    near = F.col("_n") - F.col("_last") < k
    found = runs.where("_anchor = 1").select(
        key, F.col("_at").alias("anchor"), F.when(near, F.col("_run")).otherwise(F.col("_at")).alias("onset")
    )
    return found.dropDuplicates([key, "anchor"])
