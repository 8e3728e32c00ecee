import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineweave.llm.packing import pack, plan_buckets
from lineweave.llm.topk import best_of_tile, products, top_k

from .conftest import rows

VECTORS = "vec_id long, embedding array<float>, label int, rank int, score int, dim int, mark int"


def plain_top(vectors, k):
    quantised = []
    for i, v in vectors:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            quantised.append((i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]))
    out = set()
    for q, a in quantised:
        if q % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in quantised if i != q and len(b) == len(a))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def test_top_k(spark):
    rng = random.Random(7)
    vectors = [(i, [rng.choice([-0.5, 0.25, 0.1, 3.3]) for _ in range(3)]) for i in range(330)]
    vectors += [(-100, [1.0, 2.0]), (401, [1.0, 2.0]), (402, [3.0, 2.0]), (500, None), (600, []), (700, [1.0, None, 2.0]), (800, [float("nan")] * 3),
                (900, [float("inf"), 0.0, 0.0]), (None, [1.0, 2.0, 3.0]), (1000, [1e30, -1e30, 1.0]), (1001, [1e6, 1e7, 1e5])]
    df = spark.createDataFrame([(*v, 1, 2, 3, 4, 5) for v in vectors], VECTORS).repartition(3)
    got = {tuple(r) for r in top_k(df.where("vec_id % 100 = 0"), df, 10).collect()}
    lowest, highest = -(1 << 63) + 1, (1 << 63) - 1
    want = {(q, n, i, max(lowest, min(highest, s))) for q, n, i, s in plain_top(vectors, 10)}
    # scores that are held at the ends of the range tie there; all else is exact
    tied = {1000}
    assert {r for r in got if r[0] not in tied} == {r for r in want if r[0] not in tied}
    assert len([r for r in got if r[0] in tied]) == 10


def test_repeated_rows_are_candidates_each_and_one_query(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in top_k(df.where("vec_id % 100 = 0"), df, 10).collect())
    assert got == [(100, 1, 1, 1048576), (100, 2, 1, 1048576)]


def test_components_at_the_end_of_double(spark):
    rows_ = [(100, [1.7e308, 1e-3, -1.0]), (200, [-1.7e308, 0.0, 1.0]), (1, [1.7e308, 1.0, 0.0]), (2, [0.0, 2.0, 0.0]), (3, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in top_k(df.where("vec_id % 100 = 0"), df, 2).collect()}
    top = (1 << 63) - 1
    assert got == {(100, 1, 1, top), (100, 2, 2, 2048), (200, 1, 3, top), (200, 2, 2, 0)}


@pytest.mark.parametrize("blocks", [1, 3])
def test_top_k_over_many_groups(spark, monkeypatch, blocks):
    from lineweave.llm import topk

    monkeypatch.setattr(topk, "QUERY_BLOCKS", blocks)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "SHARD_BLOCK", 16)
    rng = random.Random(9)
    vectors = [(i, [rng.choice([-0.5, 0.25, 0.1]) for _ in range(2 + i % 2)]) for i in range(0, 3000, 5)]
    df = spark.createDataFrame([(*v, 1, 2, 3, 4, 5) for v in vectors], VECTORS).repartition(5)
    assert {tuple(r) for r in top_k(df.where("vec_id % 100 = 0"), df, 10).collect()} == plain_top(vectors, 10)


def test_no_vectors(spark):
    df = spark.createDataFrame([], VECTORS)
    assert top_k(df, df).collect() == []


@pytest.mark.parametrize("scale", [1, 1e6, 1e12, 1e307])
def test_products_are_exact(scale):
    rng = np.random.default_rng(1)
    a, b = (rng.normal(size=(5, 16)) * scale for _ in range(2))
    exact = lambda x: math.floor(1024 * Fraction(x))
    whole = [[sum(exact(x) * exact(y) for x, y in zip(p.tolist(), q.tolist(), strict=True)) for q in b] for p in a]
    limit = (1 << 63) - 1
    assert products(a, b).tolist() == [[max(-limit, min(limit, x)) for x in r] for r in whole]


@pytest.mark.parametrize("scale", [1, 1 << 58])
def test_ties_of_a_tile_go_to_smaller_places(scale):
    rng = np.random.default_rng(2)
    scores = rng.integers(-3, 4, size=(20, 40)) * scale
    own = rng.random((20, 40)) < 0.1
    r, c = best_of_tile(scores, own, 10)
    for i in range(20):
        want = sorted((j for j in range(40) if not own[i, j]), key=lambda j: (-int(scores[i, j]), j))[:10]
        assert set(c[r == i].tolist()) >= set(want) - set() if (~own[i]).sum() <= 10 else set(want) <= set(c[r == i].tolist())


def plain_padding(histogram, buckets):
    lengths = sorted(histogram)
    best = None
    for size in range(1, min(buckets, len(lengths)) + 1):
        for inner in itertools.combinations(lengths[:-1], size - 1):
            bounds = [*inner, lengths[-1]]
            cost = sum(c * (min(b for b in bounds if b >= n) - n) for n, c in histogram.items())
            best = cost if best is None else min(best, cost)
    return best


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(60):
        histogram = {rng.randrange(0, 60): rng.randrange(1, 50) for _ in range(rng.randrange(1, 10))}
        for buckets in (1, 2, 3, 5):
            plan = plan_buckets(histogram, buckets)
            cost = sum(c * (min(b for b in plan.boundaries if b >= n) - n) for n, c in histogram.items())
            assert cost == plan.padding == plain_padding(histogram, buckets)
            assert len(plan.boundaries) <= buckets
    assert plan_buckets({}, 3).boundaries == []


def check_packing(found, totals, max_tokens, token_budget):
    """Every token is in one piece; batches keep the budget and are full but for the last of a bucket."""
    pieces = {}
    batches = {}
    for r in found:
        assert 0 <= r.n_tokens <= r.bucket_tokens <= max_tokens
        assert r.padding == r.bucket_tokens - r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
        batches.setdefault((r.bucket, r.bucket_tokens), {}).setdefault(r.batch, []).append(r.slot)
    for doc_id, counts in totals.items():
        want = sorted((a, min(max_tokens, n - a)) for n in counts for a in range(0, max(n, 1), max_tokens))
        assert sorted(pieces[doc_id]) == want
    assert set(pieces) == set(totals)
    for (_, size), own in batches.items():
        capacity = max(1, token_budget // max(size, 1))
        assert sorted(own) == list(range(len(own)))
        for number, slots in own.items():
            assert sorted(slots) == list(range(len(slots)))
            assert len(slots) == capacity or (number == len(own) - 1 and len(slots) < capacity)


def test_packing(docs, no_docs):
    totals = {}
    for i, text, *_ in rows():
        totals.setdefault(i, []).append(len((text or "").encode().split()))
    check_packing(pack(docs, max_tokens=700, buckets=4, token_budget=2000).collect(), totals, 700, 2000)
    assert pack(no_docs).collect() == []


def test_packing_over_many_shards(spark, monkeypatch):
    from lineweave.llm import packing

    monkeypatch.setattr(packing, "SHARD", 50)
    df = spark.range(1500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"))
    check_packing(pack(df, buckets=5, token_budget=100).collect(), {i: [i % 37] for i in range(1500)}, 2048, 100)


def test_packing_of_tokens(docs, no_docs):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    want, totals = {}, {}
    for i, text, *_ in rows():
        want.setdefault(i, []).append(reference.encode_ordinary(text or ""))
        totals.setdefault(i, []).append(len(want[i][-1]))
    found = pack(docs, (path, public_tokenizers.PATTERN), max_tokens=300, buckets=4, token_budget=2000).collect()
    check_packing(found, totals, 300, 2000)
    for r in found:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.n_tokens
        assert any(ids == w[r.first_token : r.first_token + 300] for w in want[r.doc_id])
    assert pack(no_docs, (path, public_tokenizers.PATTERN)).collect() == []
