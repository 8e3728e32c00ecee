"""SQL names for functions that Spark does not have."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .pixels import edge_overlap, mask_change
from .text import nfkc, normalize_text, text_key

_FIELD = StructType(
    [StructField(n, IntegerType() if n in ("ordinal", "start", "end") else StringType())
     for n in ("key", "ordinal", "category", "name", "source", "start", "end")]
)


class ParseFields:
    """``parse_fields(line)``: the exposed fields of a command, as rows."""

    def eval(self, line: str):
        from ..sources.scripts import parse_fields

        yield from parse_fields(line or "")


def register(spark: SparkSession) -> None:
    """Register nfkc, text_normalize, text_key, edge_overlap, mask_change and the table function parse_fields."""
    for name, function in {
        "nfkc": nfkc,
        "text_normalize": normalize_text,
        "text_key": text_key,
        "edge_overlap": edge_overlap,
        "mask_change": mask_change,
    }.items():
        spark.udf.register(name, function)
    spark.udtf.register("parse_fields", udtf(ParseFields, returnType=_FIELD))
