"""Verification tables (CSV): strict scan, checksum, and field-by-field cross-check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scripts import field_id

HEADER = ["id", "name", "text", "trans"]
# Ids of the two trailer rows.
INFO_ID, TRANSLATOR_ID = "info", "译者"


def read_check_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a check table; another header, or rows with missing or extra cells, fail the query."""
    return (
        spark.read.schema(", ".join(f"{c} string" for c in HEADER))
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .option("nullValue", "\u0000")
        .option("emptyValue", "")
        .csv(path)
    )


def verify_fields(check: DataFrame, fields: DataFrame) -> DataFrame:
    """Faults of a check table (id, text) against script fields: one row (id, fault) for each.

    Rows may name a field by its key or by its category.  ``unknown``: no such field, ``repeated``:
    named before, ``differs``: other text, ``missing``: a field that no row names.
    """
    wanted = fields.where("key <> 'name'").select(
        field_id().alias("field"),
        F.explode(F.array_distinct(F.array(field_id(), field_id(category=True)))).alias("id"),
        "source",
    )
    # the same spelling may stand for two fields; the first one is meant
    first = wanted.groupBy("id").agg(F.min_by(F.struct("field", "source"), "field").alias("f"))
    named = check.join(first, "id", "left").select("id", "text", "f.field", "f.source")
    counts = named.groupBy("field").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("field IS NOT NULL")
    return (
        named.where("field IS NULL").select("id", F.lit("unknown").alias("fault"))
        .unionByName(counts.where("n > 1").select("id", F.lit("repeated").alias("fault")))
        .unionByName(named.where("source <> text").select("id", F.lit("differs").alias("fault")))
        .unionByName(
            fields.where("key <> 'name'")
            .select(field_id().alias("field"))
            .join(named.select("field"), "field", "left_anti")
            .select(F.col("field").alias("id"), F.lit("missing").alias("fault"))
        )
    )


def verify_source(check: DataFrame, files: DataFrame) -> DataFrame:
    """(script_id, ok, actual): whether the info row names the file and the SHA-256 of its bytes, which is ``actual``."""
    info = check.where(F.col("id") == INFO_ID).select(F.col("name").alias("script_id"), F.col("text").alias("digest"))
    return files.select("script_id", F.sha2("content", 256).alias("actual")).join(info, "script_id", "left").select(
        "script_id", F.coalesce(F.col("digest") == F.col("actual"), F.lit(False)).alias("ok"), "actual"
    )
