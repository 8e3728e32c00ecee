import itertools
import random
import re

import pytest

import corpus_pipeline as pipeline
from lineweave.llm import near_text
from lineweave.llm.near_text import near_groups, near_pairs

from .conftest import prose, rows


def plain_shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def plain_components(data, least=0.8):
    """Smallest id of the component of each row, by comparing all pairs."""
    sets = [plain_shingles(t) for _, t in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(data)), 2):
        if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    roots = [find(i) for i in range(len(data))]
    return [min((d[0] for d, r in zip(data, roots, strict=True) if r == root and d[0] is not None), default=None) for root in roots]


def varied(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("held", [near_text.HELD, 3])
def test_near_groups_against_all_pairs(spark, docs, no_docs, monkeypatch, held):
    monkeypatch.setattr(near_text, "HELD", held)  # 3: most buckets take the way of large ones
    monkeypatch.setattr(near_text, "CHUNK", 4 if held == 3 else near_text.CHUNK)
    rng = random.Random(7)
    data = []
    for family in range(12):  # chains too: copies of copies, similarities on both sides of 0.8
        words = [f"f{family}w{rng.randrange(500)}" for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(14):
            data.append((len(data), varied(rng, words, rng.randrange(0, max(2, len(words) // 20)))))
    data += [(900, "two words"), (901, "TWO  words"), (902, "two"), (903, None), (904, "")]
    found = near_groups(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
    want = plain_components(data)
    assert 12 < len(set(want)) < len(data) - 20
    assert sorted((r.doc_id, r.component_id) for r in found) == sorted((i, c) for (i, _), c in zip(data, want, strict=True))
    data = [r[:2] for r in rows()]
    found = near_groups(docs).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in found) == sorted(
        str((i, c)) for (i, _), c in zip(data, plain_components(data), strict=True)
    )
    assert near_groups(no_docs).collect() == []


def test_near_copies_are_linked_once_each():
    import numpy as np

    sets = [np.append(np.arange(100), 1000 + i) for i in range(500)]
    assert len(list(near_pairs(sets, 0.8))) == 499


@pytest.mark.parametrize(("changes", "kept"), [([50], [1]), ([10, 30, 50, 70, 90], [1, 2])])
def test_near_stage_drops_what_differs_in_many_bits(spark, changes, kept):
    words = prose(5, 120).split()
    other = list(words)
    for i in changes:
        other[i] = f"changed{i}"
    data = [(1, " ".join(words)), (2, " ".join(other))]
    left = pipeline.near_stage(spark, spark.createDataFrame(data, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in left.collect()) == kept


def test_near_stage_leaves_no_near_pair(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    exact = pipeline.exact_stage(spark, docs, "").cache()
    data = [(r.doc_id, r.text) for r in exact.collect()]
    want = sorted(i for (i, _), c in zip(data, plain_components(data), strict=True) if i == c)
    assert len(want) < len(data)
    assert sorted(r.doc_id for r in pipeline.near_stage(spark, exact, "").collect()) == want


def test_fingerprints_are_majorities_of_all_shingles_and_near_ones_share_a_start():
    import numpy as np

    rng = np.random.default_rng(4)
    ring = near_text.Ring.of(1000)
    # one shingle's votes are its fingerprint, up to the bits it votes against; three decide by majority
    three = rng.integers(0, 1 << 64, 3, dtype=np.uint64)
    found = near_text.simhashes([three[:1], three[1:2], three[2:], three], ring)
    one = np.unpackbits(found, axis=1)
    assert (one[3] == (one[:3].sum(axis=0) >= 2)).all()
    # near sets of 0.8: within the budget, and with a start whose runs are within theirs
    for size in (9, 90, 900):
        pool = rng.integers(0, 1 << 64, (50, size // 9 * 10), dtype=np.uint64)
        left, right = near_text.simhashes([p[: size] for p in pool], ring), near_text.simhashes([p[size // 9 :] for p in pool], ring)
        assert near_text.within_budget(left ^ right).all()
        differ = np.unpackbits(left ^ right, axis=1, count=ring.bits).reshape(50, ring.segments, ring.width).sum(axis=2)
        runs = np.cumsum([np.roll(differ, -i, axis=1) for i in range(1 + 2 * ring.run)], axis=0)
        ways = (differ == 0) & (runs[ring.run] <= ring.allowed(1 + ring.run)) & (runs[-1] <= ring.allowed(1 + 2 * ring.run))
        assert ways.any(axis=1).all()


def own_words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]


def test_candidate_links_follow_the_texts_of_a_group_not_its_keys(spark, monkeypatch):
    rng, seen, join = random.Random(11), [], near_text.connected_components
    words = own_words(rng, 120)
    data = [(i, varied(rng, words, 4)) for i in range(150)]

    def counted(links):
        seen.append(links.count())
        return join(links)

    monkeypatch.setattr(near_text, "connected_components", counted)
    found = near_groups(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == list(enumerate(plain_components(data)))
    assert max(seen) < 3 * len(data)  # a tree for every segment before


def test_groups_of_texts_that_are_not_near_are_divided_by_their_fingerprints(spark, monkeypatch):
    rng, large = random.Random(12), []
    common = own_words(rng, 120)  # 0.43 similar, which runs of segments let pass
    data = [(i, " ".join(common + own_words(rng, 80))) for i in range(40)]
    data.append((40, data[7][1] + " more"))
    links = near_text.hot_links
    monkeypatch.setattr(near_text, "HELD", 3)
    monkeypatch.setattr(near_text, "PRINTS", 8)
    monkeypatch.setattr(near_text, "PASSING", 2)
    monkeypatch.setattr(near_text, "hot_links", lambda members, *more: (large.append(members.count()), links(members, *more))[1])
    found = near_groups(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
    want = plain_components(data)
    assert want[40] == 7
    assert sorted((r.doc_id, r.component_id) for r in found) == list(enumerate(want))
    assert large == []


def shuffled(spark):
    """Bytes that the stages of the session have written for shuffles."""
    gateway = spark.sparkContext._gateway
    nothing = gateway.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(nothing, False, False, gateway.new_array(gateway.jvm.double, 0), nothing)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_of_no_group_do_not_move(spark):
    rng, edge = random.Random(13), "spark.sql.autoBroadcastJoinThreshold"
    data = [(i, " ".join(own_words(rng, 2000))) for i in range(300)]
    data.append((300, data[5][1] + " more"))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4).localCheckpoint()
    was, before = spark.conf.get(edge), shuffled(spark)
    spark.conf.set(edge, -1)
    try:
        found = near_groups(docs).collect()
    finally:
        spark.conf.set(edge, was)
    assert sorted((r.doc_id, r.component_id) for r in found if r.doc_id in (5, 300)) == [(5, 5), (300, 5)]
    assert shuffled(spark) - before < sum(len(t) for _, t in data) / 2


def test_near_copies_of_a_hub_are_not_compared_chunk_by_chunk(spark, monkeypatch):
    rng = random.Random(14)
    words = own_words(rng, 120)
    data = [(i, varied(rng, words, 2)) for i in range(60)]

    def none(batches):
        for batch in batches:
            assert not batch.num_rows
            yield batch.select(["k", "node"]).rename_columns(["a", "b"])

    monkeypatch.setattr(near_text, "HELD", 3)
    monkeypatch.setattr(near_text, "PRINTS", 8)
    monkeypatch.setattr(near_text, "_print_tile", none)
    found = near_groups(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == list(enumerate(plain_components(data)))
