"""Aggregates over what a recogniser saw in one image, or over several attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def weighted_confidence(text: Column, confidence: Column) -> Column:
    """Mean confidence of fragments, weighted by their lengths (one at least)."""
    weight = F.greatest(F.lit(1), F.length(F.trim(text))).cast("double")
    return F.sum(confidence * weight) / F.sum(weight)


def union_box(x0: str, y0: str, x1: str, y1: str, width: int, height: int) -> Column:
    """The box around all boxes with a margin, inside the image."""
    edge = lambda c: F.greatest(F.lit(0), F.floor(F.min(c)).cast("int") - 2)
    far = lambda c, most: F.least(F.lit(most), F.ceil(F.max(c)).cast("int") + 3)
    return F.struct(
        edge(x0).alias("x0"), edge(y0).alias("y0"), far(x1, width).alias("x1"), far(y1, height).alias("y1")
    )


def best_reading(attempts: DataFrame, key: str) -> DataFrame:
    """The most confident attempt (key, attempt, text_key, confidence) of each key, the first on ties, and how many agree."""
    best = Window.partitionBy(key).orderBy(F.desc("confidence"), "attempt")
    marked = attempts.withColumn("_best", F.first("text_key").over(best)).withColumn("_n", F.row_number().over(best))
    return (
        marked.groupBy(key)
        .agg(
            F.min(F.when(F.col("_n") == 1, F.col("attempt"))).alias("attempt"),
            F.first("_best").alias("text_key"),
            F.max("confidence").alias("confidence"),
            F.count_if(F.col("text_key") == F.col("_best")).alias("agreements"),
        )
    )


def wide_enough(attempts: DataFrame, key: str, share: float = 0.95) -> DataFrame:
    """Attempts (key, attempt, width) that keep ``share`` of the width of attempt 0, and attempt 0 itself."""
    raw = F.greatest(
        F.lit(1), F.max(F.when(F.col("attempt") == 0, F.col("width"))).over(Window.partitionBy(key))
    )
    return attempts.withColumn("_raw", raw).where((F.col("attempt") == 0) | (F.col("width") >= F.col("_raw") * share)).drop("_raw")


def reading_order(boxes: Column) -> Column:
    """Places of boxes (array of struct<i, x, cy, h>) in reading order.

    By vertical centre, a box joins the first row whose centre is within half the smaller height, else opens one;
    rows follow each other, each from left to right.
    """
    ordered = F.array_sort(
        boxes,
        lambda a, b: F.when(a["cy"] < b["cy"], -1).when(a["cy"] > b["cy"], 1).when(a["i"] < b["i"], -1).otherwise(1),
    )

    def fits(row: Column, box: Column) -> Column:
        height = F.greatest(F.lit(1.0), box["h"])
        return F.abs(box["cy"] - row["center"]) <= F.least(height, row["height"]) * 0.5

    def place(rows: Column, box: Column) -> Column:
        home = F.get(F.filter(F.sequence(F.lit(0), F.size(rows)), lambda j: (j < F.size(rows)) & fits(F.get(rows, j), box)), F.lit(0))
        fresh = F.struct(
            box["cy"].alias("center"),
            F.greatest(F.lit(1.0), box["h"]).alias("height"),
            F.array(box).alias("members"),
        )
        joined = F.transform(
            rows,
            lambda row, j: F.when(
                j == home,
                F.struct(
                    row["center"].alias("center"),
                    row["height"].alias("height"),
                    F.array_append(row["members"], box).alias("members"),
                ),
            ).otherwise(row),
        )
        return F.when(home.isNull(), F.array_append(rows, fresh)).otherwise(joined)

    box_type = "struct<i: int, x: double, cy: double, h: double>"
    rows = F.aggregate(
        ordered, F.array().cast(f"array<struct<center: double, height: double, members: array<{box_type}>>>"), place
    )
    left_first = lambda a, b: F.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).when(
        (a["cy"] < b["cy"]) | ((a["cy"] == b["cy"]) & (a["i"] < b["i"])), -1
    ).otherwise(1)
    return F.flatten(
        F.transform(rows, lambda row: F.transform(F.array_sort(row["members"], left_first), lambda b: b["i"]))
    )


def joined_text(fragments: DataFrame, key: str, keep_rows: bool) -> DataFrame:
    """Fragments (key, row, place, text) put together in reading order; rows on lines of their own if asked for."""
    rows = fragments.groupBy(key, "row").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda f: f["text"]), ""
        ).alias("text")
    )
    return rows.groupBy(key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda r: r["text"]), "\n" if keep_rows else ""
        ).alias("text")
    )
