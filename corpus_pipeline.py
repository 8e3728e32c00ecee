"""A training-data pipeline over ``documents``: language ID, exact dedup, near dedup, substring dedup, packing.

Every stage takes what the one before it kept.  All but the last return the columns of their input, whatever further
columns there are; the last returns pieces of token ids, dealt into batches.

Defined results, besides those of the operators: documents without letters go in the first stage, null and empty texts
with them; a null ``lang`` becomes the predicted one; null ids are ids like any other; rows that repeat id and text are
one document from the second stage on; of equal or near texts the row stays that the stage names, whatever ties there
are otherwise; very long texts are never cut before packing, which makes many pieces of them; empty tables go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm.common import bounded_batches, marked_rows, shared_folder, stored, table
from lineweave.llm.exact_dedup import exact_dedup
from lineweave.llm.language_id import held_out, is_foreign, learn_profiles, predict
from lineweave.llm.packing import pack
from lineweave.llm.queries import tokenizer
from lineweave.llm.simhash import near_groups
from lineweave.llm.substring_dedup import SPARED_BELOW, substring_dedup
from lineweave.session import ship

#: Names of columns that stages put beside those of the documents for a while.
JUDGED = ("__lw_lang", "__lw_score", "__lw_distance", "__lw_ngrams")
KEY, ID, ROW = "__lw_key", "__lw_id", "__lw_row"


def _without(docs: DataFrame, dropped: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows whose id and text_key are in ``dropped`` (doc_id, text_key); rows whose text_key is in
    ``once`` (text_key) and that repeat id and text stay once.  Rows with other texts do not move."""
    names = [f"`{n}`" for n in docs.columns]
    keyed = docs.withColumns({KEY: F.xxhash64(F.coalesce(docs["text"], F.lit(""))), ID: docs["doc_id"].cast("long")})
    gone = stored(dropped.select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct())
    touched, untouched = marked_rows(keyed, once if once is not None else gone.select("_gone_key"), KEY)
    on = touched[ID].eqNullSafe(gone["_gone_id"]) & (touched[KEY] == gone["_gone_key"])
    left = touched.join(gone, on, "left_anti")
    if once is not None:
        left = left.dropDuplicates([ID, KEY])
    return left.select(*names).unionByName(untouched.select(*names))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in none of the learned languages go, those without letters included."""
    bounded_batches(spark)
    profiles = learn_profiles(docs.where(~held_out()))
    if not profiles:  # where nothing could be learned, nothing is rejected
        return docs
    lang, _, distance, ngrams = (F.col(c) for c in JUDGED)
    judged = predict(docs, profiles, JUDGED).where(~is_foreign(lang, distance, ngrams))
    return judged.withColumn("lang", F.coalesce("lang", lang)).select(*[f"`{n}`" for n in docs.columns])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id stays, once."""
    bounded_batches(spark)
    found = stored(exact_dedup(docs).where("group_size > 1").select("doc_id", "text_key", "kept"))
    return _without(docs, found.where("NOT kept"), found.select("text_key").distinct())


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 or more over 5-word shingles, the document with the smallest doc_id stays."""
    bounded_batches(spark)
    found = near_groups(docs)
    return _without(docs, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; documents of which nothing is left go."""
    bounded_batches(spark)
    whole = docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias(ROW))
    cut = substring_dedup(whole, SPARED_BELOW, keep=[ROW])
    same = F.size("removed") == 0
    some = (F.trim(F.regexp_replace("text", r"\s+", " ")) != "") | same

    def column(name: str):
        if name == "text":
            return F.col("text")
        if name == "n_chars":
            old = F.col(f"{ROW}.n_chars")
            return F.when(same, old).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)).alias(name)
        return F.col(f"{ROW}.`{name}`").alias(name)

    return cut.where(some | F.col("text").isNull()).select(*[column(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in batches of like lengths."""
    bounded_batches(spark)
    return pack(docs, tokenizer())


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: Components of near texts and the optimal buckets have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    ship(spark)
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{folder}/{number}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
