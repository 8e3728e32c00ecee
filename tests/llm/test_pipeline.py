import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lineweave.llm import queries as llm
from lineweave.llm import substring_dedup as sub

from .conftest import rows
from .test_dedup import plain_substring
from .test_near_text import plain_components
from .test_search_and_packing import check_packing

SF_DIR = "/root/testdata/sf0.001"


def plain_stages(data):
    """(id, text) that is left after each stage but the last, by brute force; data without null or repeated ids.  Every
    text with letters of this sample is in a learned language (see test_what_is_in_no_learned_language_is_foreign)."""
    data = [(i, t) for i, t in data if any(c.isalpha() for c in t or "")]
    yield data
    last = {}
    for i, t in data:
        last[t] = max(last.get(t, i), i)
    data = [(i, t) for i, t in data if last[t] == i]
    yield data
    data = [(i, t) for (i, t), c in zip(data, plain_components(data), strict=True) if c == i]
    yield data
    data = [(i, t) for i, t, cut in plain_substring(data) if t.strip() or not cut]
    yield data


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the sample tables are not here")
def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = docs.columns
    data = [(r.doc_id, r.text) for r in docs.collect()]
    for (name, stage), want in zip(pipeline.STAGES, plain_stages(data), strict=False):
        docs = stage(spark, docs, SF_DIR).cache()
        assert docs.columns == names
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want), name
    from tiktoken import Encoding
    from tiktoken.load import load_tiktoken_bpe

    path, pattern = llm.tokenizer()
    reference = Encoding("t", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    ids = {i: reference.encode_ordinary(t) for i, t in want}
    found = pipeline.run(spark, SF_DIR).collect()
    check_packing(found, {i: [len(x)] for i, x in ids.items()}, 2048, 16384)
    for r in found:
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == ids[r.doc_id][r.first_token : r.first_token + 2048]


def test_foreign_documents_go_and_null_languages_are_filled(spark):
    rng = random.Random(3)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(150).cache()
    noise = " ".join("".join(rng.choice("qxzjkvwy") for _ in range(6)) for _ in range(90))
    more = spark.createDataFrame([(10**6, noise, "en", "s", 1), (10**6 + 1, docs.first().text, None, "s", 1)], docs.schema)
    left = {r.doc_id: r for r in pipeline.language_stage(spark, docs.unionByName(more), "").collect()}
    assert 10**6 not in left
    assert left[10**6 + 1].lang == docs.first().lang
    assert len(left) == docs.where(F.col("text").rlike(r"\p{L}")).count() + 1


def test_stages_over_odd_rows(spark, docs, no_docs):
    for table in (docs, no_docs):
        left = table
        for name, stage in pipeline.STAGES[:-1]:
            left = stage(spark, left, "").cache()
            assert left.columns == table.columns, name
        left.count()
        pipeline.STAGES[-1][1](spark, left, "").collect()
    kept = [(r.doc_id, r.text) for r in left.collect()]
    assert kept == []


def test_what_odd_rows_leave(spark, docs):
    left = docs
    for _, stage in pipeline.STAGES[:2]:
        left = stage(spark, left, "").cache()
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == [-100, 2, 3, 8, 10, 11, 12, 13, 14]
    assert ids.count(None) == 1


def test_every_operator_has_its_query():
    names = list(llm.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 11))
    assert set(llm.oracle_sql()) <= set(names)
    assert sub.SPARED_BELOW <= 50
    assert len(rows()) == 19


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the sample tables are not here")
def test_queries_against_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        duck.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = duck.sql(llm.oracle_sql()[name])
    columns = result.columns
    want = sorted(map(str, result.fetchall()))
    got = sorted(map(str, map(tuple, llm.queries()[name](spark, SF_DIR).select(*columns).collect())))
    assert got == want
