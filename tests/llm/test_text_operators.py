import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineweave.llm import html_text as html
from lineweave.llm import language_id as lang
from lineweave.llm import license_scan as lic
from lineweave.llm import lm_score as lm
from lineweave.llm.bpe import LONG, Encoder, Vocabulary, bpe_encode

from .conftest import prose, rows

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(str(tokenizers.path("byte_bpe_50k.tiktoken")))


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_bpe_is_what_tiktoken_gives(vocabulary, reference):
    rng = random.Random(2)
    texts = ["", "a", "<|endoftext|> x", " \n\n  \t x  ", "日本語 𝒳𝒴 👩‍👩‍👧", "The" * 171]
    texts += ["a" * n for n in (LONG - 1, LONG, LONG + 1, 5000)] + ["ab" * 700, "=-" * 900, "é" * 600]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 700)])) for _ in range(rng.randrange(200))) for _ in range(200)]
    encoder = Encoder(vocabulary, tokenizers.PATTERN)
    for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
        ids = np.frombuffer(ids, dtype="<u4")
        assert ids.tolist() == reference.encode_ordinary(text)
        assert vocabulary.decode(ids.astype(np.int64)) == text.encode()


def test_a_full_memory_changes_nothing(vocabulary, monkeypatch):
    from lineweave.llm import bpe

    texts = [prose(i, 200) for i in range(20)]
    whole = Encoder(vocabulary, tokenizers.PATTERN).encode_all(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    encoder = Encoder(vocabulary, tokenizers.PATTERN)
    assert [encoder.encode_all([t])[0] for t in texts] == whole


def test_bpe_over_a_table(docs, no_docs, reference):
    args = (str(tokenizers.path("byte_bpe_50k.tiktoken")), tokenizers.PATTERN)
    want = []
    for i, text, *_ in rows():
        ids = reference.encode_ordinary(text or "")
        want.append(
            (i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        )
    assert sorted(map(str, map(tuple, bpe_encode(docs, *args).collect()))) == sorted(map(str, want))
    assert bpe_encode(no_docs, *args).collect() == []
    assert bpe_encode(docs.where("doc_id = 13"), *args, ids=True).first().ids == reference.encode_ordinary("word")


def plain_ngrams(text):
    counts = Counter()
    for word in "".join(c.lower()[0] if c.isalpha() else " " for c in text).split():
        padded = f" {word} "
        counts.update(g for n in range(1, lang.ORDER + 1) for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g.strip())
    return counts


def test_ngrams(monkeypatch):
    for text in ("Hello, World! été", "", "12", "a b", "İstanbul ß x", " lead"):
        assert sorted(lang.count_ngrams([text])[2]) == sorted(plain_ngrams(text).values())
    for size in (7, 8, 9):
        monkeypatch.setattr(lang, "CHARS", size)
        for text in ("ab cd ef gh ij kl ab cd", "abcdefghijklmnopqrstuvwxyzabcd" * 3, "x abcdefghij1klmnopqrstuv, wxyzabcde", "abcdefg hijklmno12345678901"):
            assert sorted(lang.count_ngrams([text])[2]) == sorted(plain_ngrams(text).values()), (size, text)


def ranked(counts, keys):
    """N-grams in rank order; ties go by their keys, as in the operator."""
    order = sorted(counts, key=lambda g: (-counts[g], keys[g]))
    return {g: r for r, g in enumerate(order[: lang.PROFILE])}


def test_predictions_are_those_of_the_definition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    data = docs.collect()
    counts = {r.doc_id: plain_ngrams(r.text or "") for r in data}
    every = set().union(*counts.values())
    keys = {}
    for n in (1, 2, 3):
        for g in (g for g in every if len(g) == n):
            letters = np.array([ord(c) for c in g], dtype=np.uint64)
            raw = sum(int(c) << 20 * k for k, c in enumerate(letters)) | n << 61
            keys[g] = int(lang.mix64(np.array([raw], dtype=np.uint64))[0]) >> 24
    teach = {}
    for r in data:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            teach.setdefault(r.lang, Counter()).update(counts[r.doc_id])
    profiles = {name: ranked(c, keys) for name, c in teach.items()}
    for r in lang.language_id(docs).collect():
        own = ranked(counts[r.doc_id], keys)
        if not own:
            assert (r.lang_pred, r.score, r.distance) == ("und", 0.0, None)
            continue
        apart = {n: sum(abs(p[g] - k) if g in p else lang.PROFILE for g, k in own.items()) for n, p in profiles.items()}
        first, second = sorted(apart.values())[:2]
        assert r.lang_pred == min(apart, key=lambda n: (apart[n], n))
        assert r.score == pytest.approx((second - first) / max(second, 1))
        assert r.distance == pytest.approx(first / lang.PROFILE / len(own))
        assert r.ngrams == len(own)


def test_what_is_in_no_learned_language_is_foreign(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = lang.learn_profiles(docs)
    rng = random.Random(5)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(n)) for n in (100, 1000, 9000)]
    noise += ["Широка страна моя родная, много в ней лесов, полей и рек, я другой такой страны не знаю, где так вольно дышит человек"]
    rows_ = [(i, t) for i, t in enumerate([*noise, "short", "zq"])]
    verdict = lang.is_foreign(*(F.col(c) for c in ("lang_pred", "distance", "ngrams")))
    got = lang.predict(spark.createDataFrame(rows_, "doc_id long, text string"), profiles).where(verdict).collect()
    assert {r.doc_id for r in got} == set(range(4))
    assert lang.predict(docs, profiles).where(verdict & (F.col("lang_pred") != "und")).count() == 0


def test_language_id_is_right_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = lang.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in found)


def test_language_id_of_odd_rows(docs, no_docs):
    found = lang.language_id(docs).collect()
    assert len(found) == len(rows())
    by_id = {r.doc_id: r for r in found}
    for i in (4, 5, 6, 7):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[9].lang_pred in ("en", "de")
    assert lang.language_id(no_docs).collect() == []


def test_nothing_learned_means_unknown(docs):
    assert {r.lang_pred for r in lang.predict(docs, {}).collect()} == {"und"}


def plain_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for p, label in lic.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in found}))


def test_license_scan(docs, no_docs):
    got = lic.license_scan(docs).collect()
    key = lambda r: str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
    assert sorted(map(key, got)) == sorted(str((i, *plain_places(t))) for i, t, *_ in rows())
    assert all(0 <= r.score <= 1 for r in got)
    assert lic.license_scan(no_docs).collect() == []


def plain_votes(text, templates, k=lic.K):
    """Labels by diagonals, merged and verified, without hashes or joins."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, labels = split(text), set()
    for label, template in templates:
        t = split(template)
        grams = max(0, len(t) - k + 1)
        votes = {}
        for p in range(len(words) - k + 1):
            for q in range(grams):
                if words[p : p + k] == t[q : q + k]:
                    votes.setdefault(p - q, set()).add((p, q))
        run, last = [], None
        runs = []
        for d in sorted(votes):
            if last is not None and d - last > lic.SLACK:
                runs.append(run)
                run = []
            run, last = run + sorted(votes[d]), d
        for run in [*runs, run]:
            places = {p + j for p, _ in run for j in range(k)}
            covered = {q + j for _, q in run for j in range(k)}
            if run and len(covered) / len(t) >= lic.COVERAGE and len(places) / (max(places) - min(places) + 1) >= lic.DENSITY:
                labels.add(label)
    return labels


def test_license_spans_with_words_changed(spark):
    rng = random.Random(6)
    data = []
    for i in range(60):
        text = rng.choice(lic.TEMPLATES)[1].split()
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = [rng.choice(["", "some", "other words"])]
        data.append((i, f"{prose(i, 15)} {' '.join(text)} {prose(i + 99, 15)}"))
    got = lic.license_scan(spark.createDataFrame(data, "doc_id long, text string")).collect()
    for r in got:
        assert set(filter(None, r.labels.split(","))) == plain_votes(data[r.doc_id][1], lic.TEMPLATES) | set(filter(None, r.base_labels.split(",")))


def test_full_license_texts(spark):
    data = [(i, f"{prose(i, 30)}\n{text.upper()}\n{prose(i + 50, 30)}") for i, (_, text) in enumerate(lic.TEMPLATES)]
    got = {r.doc_id: r for r in lic.license_scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for i, (label, text) in enumerate(lic.TEMPLATES):
        assert label in got[i].labels.split(",")
        assert got[i].score == 1.0
        assert got[i].span_first <= 30
        assert got[i].span_last >= got[i].span_first


def test_equal_hashes_of_other_words_do_not_count(spark, monkeypatch):
    monkeypatch.setattr(lic, "kgram_hash", lambda words, i, k: F.lit(7).cast("long"))
    data = [(1, prose(3, 400)), (2, prose(4, 9) + " released under the MIT license " + prose(5, 9))]
    got = {r.doc_id: r for r in lic.license_scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert (got[1].labels, got[1].score) == ("", 0.0)
    assert (got[2].labels, got[2].span_first) == ("mit", 9)


def test_license_scan_is_native(docs):
    plan = lic.license_scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan.split("== Optimized")[1].split("InMemoryRelation")[0])


def plain_tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def check_base(found, data):
    counts = Counter()
    for i, text in data:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update(plain_tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text in data:
        tokens = plain_tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        want.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 5)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_lm_counts_of_odd_rows(docs, no_docs, spark, monkeypatch):
    data = [r[:2] for r in rows()]
    check_base(lm.lm_score(docs).collect(), data)
    monkeypatch.setattr(lm, "TOP", 40)  # so that most words go through the join
    check_base(lm.lm_score(docs).collect(), data)
    assert lm.lm_score(no_docs).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    alone = lm.lm_score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (alone.train_tokens, alone.n_known, alone.base_score) == (0, 0, 0.0)
    assert alone.score < 0


def test_lm_beats_its_base_on_held_out_texts(spark):
    found = lm.lm_score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").toPandas()
    assert found.score.sum() > found.base_score.sum()
    assert (found.score < 0).all()


def test_lm_weights_do_not_depend_on_the_partitioning(spark):
    docs = spark.createDataFrame([(i, prose(i, 60), i % lm.ROUNDS) for i in range(80)], "doc_id long, text string, part long")
    vocabulary = lm.summarise(lm.count_words(docs))
    part = F.col("part")
    one = lm.train_weights(docs.coalesce(1), vocabulary, part)
    many = lm.train_weights(docs.repartition(9), vocabulary, part)
    assert one.table.shape == (lm.FEATURES * vocabulary.buckets, lm.CLASSES)
    for a, b in ((one.table, many.table), (one.sub_table, many.sub_table)):
        assert np.abs(a).max() > 0.1
        assert np.abs(a - b).max() < 1e-6


def test_lm_buckets_grow_with_the_corpus():
    sizes = [lm.Vocabulary(n, 1, *[None] * 9).buckets for n in (0, 10**7, 10**8, 10**12)]
    assert sizes == [lm.LEAST, lm.LEAST, 4096, lm.MOST]


def mix(x):
    return int(lm.mix64(np.array([x % 2**64], dtype=np.uint64))[0])


class PlainScorer:
    """The model word by word, from trained weights and plain counts."""

    def __init__(self, weights, texts):
        self.w = weights
        self.counts = Counter(t for text in texts for t in plain_tokens(text))
        by_count = sorted((-n, (self.hash(t) ^ 1 << 63), t) for t, n in self.counts.items() if t is not None)
        self.singles = [t for _, _, t in by_count[: lm.SINGLES]]
        self.in_leaf, once, twice = Counter(), Counter(), Counter()
        self.types = Counter()
        for t, n in self.counts.items():
            c, leaf = self.place(t)
            self.in_leaf[leaf] += n
            self.types[leaf] += 1
            once[c] += n == 1
            twice[c] += n == 2
        self.discount = {
            c: 0.0 if c < len(self.singles) or c == lm.END_CLASS else min(0.95, max(0.1, once[c] / max(once[c] + 2 * twice[c], 1)))
            for c in range(lm.CLASSES)
        }

    def hash(self, t):
        raw = (t or "").encode()
        return int(lm.END) if t is None else int(lm.word_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0])

    def place(self, t):
        """Class and leaf of a token."""
        if t is None:
            return lm.END_CLASS, ("end",)
        if t in self.singles:
            return self.singles.index(t), (t,)
        raw = t.encode()
        c = lm.SINGLES + mix(raw[-1] << 8 | (raw[-2] if len(raw) > 1 else 0)) % lm.GROUPS
        return c, (c, (self.hash(t) >> 20) % lm.SUBS)

    def share(self, table, bias, rows, own):
        logits = np.array(bias, dtype=np.float64)
        for r in rows:
            logits += table[r]
        return logits[own] - math.log(np.exp(logits).sum())

    def score(self, text):
        tokens, total = plain_tokens(text), 0.0
        bits = self.w.buckets.bit_length() - 1
        for i, t in enumerate(tokens):
            back = [self.hash(tokens[i - d]) if i >= d else d for d in (1, 2, 3)]
            salts = [int(x) for x in lm._SALTS]
            context = [back[0], (back[1] * salts[1] + back[0]) % 2**64, back[1], back[2]]
            rows_ = [(mix(c * x) >> (64 - bits)) + k * self.w.buckets for k, (c, x) in enumerate(zip(context, salts, strict=True))]
            c, leaf = self.place(t)
            total += self.share(self.w.table, self.w.bias, rows_, c)
            if len(leaf) == 2:
                size = self.w.buckets * lm.SUB_BUCKETS
                rows_ = [
                    (mix((context[f] * salts[f]) % 2**64 ^ mix(c + 1)) >> (65 - size.bit_length())) + k * size
                    for k, f in enumerate(lm.SUB_FEATURES)
                ]
                total += self.share(self.w.sub_table, self.w.sub_bias[c - lm.SINGLES], rows_, leaf[1])
            n, seen = self.counts[t], self.in_leaf[leaf]
            if n:
                total += math.log(max(n - self.discount[c], 1e-3) / max(seen, 1))
            else:
                total += math.log(max(self.discount[c] * self.types[leaf] / seen, 1e-12)) if seen else 0.0
        return total / math.log(10)


@pytest.mark.parametrize("top", [lm.TOP, 40])
def test_lm_scores_are_those_of_the_definition(spark, monkeypatch, top):
    monkeypatch.setattr(lm, "TOP", top)
    trained = []
    train_weights = lm.train_weights
    monkeypatch.setattr(lm, "train_weights", lambda *a: trained.append(train_weights(*a)) or trained[-1])
    data = [(i, prose(i, 40 + i)) for i in range(60)] + [(100, None), (101, ""), (102, "zzz unseen Words. the the"), (103, prose(1, 30))]
    got = {r.doc_id: r.score for r in lm.lm_score(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    plain = PlainScorer(trained[0], [t for i, t in data if zlib.crc32(str(i).encode()) % 7 != 2])
    for i, text in data:
        assert got[i] == pytest.approx(plain.score(text), rel=1e-5)


def test_lm_is_a_distribution(spark):
    docs = spark.createDataFrame([(i, prose(i, 50)) for i in range(60)], "doc_id long, text string")
    counts = lm.count_words(docs)
    vocabulary = lm.summarise(counts)
    weights = lm.train_weights(docs.selectExpr("text", "doc_id % 4 AS part"), vocabulary, F.col("part"))
    words = counts.where("g >= 0").toPandas()
    hashes = words.h.to_numpy().view(np.uint64)
    index = lm.Index(vocabulary.singles)
    every = np.arange(lm.SINGLES, lm.SINGLES + lm.GROUPS)
    for text in ("", "the quick", "zzz unseen words"):
        first = lm.tokenize(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        context = [c[-1:] for c in lm.contexts(first)]
        p_class = lm.softmax(weights.logits(lm.features(context, weights.buckets)))[0]
        subs = lm.sub_features([np.repeat(c, len(every)) for c in context], every, weights.buckets)
        p_leaf = np.append(p_class[: lm.SINGLES], (p_class[every, None] * lm.softmax(weights.sub_logits(subs, every))).ravel())
        tokens = lm.Tokens(hashes, words.g.to_numpy().astype(np.int8), np.array([0]))
        leaves = lm.leaves(vocabulary.classes(tokens, index), lm.subclass(hashes))
        known = (p_leaf[leaves] * 10 ** vocabulary.known(words.n.to_numpy(), leaves)).sum()
        unknown = (p_leaf * 10 ** vocabulary.unknown()[:-1])[lm.SINGLES :].sum()
        assert known + unknown + p_class[lm.END_CLASS] == pytest.approx(1.0, abs=0.02)


PAGE = (
    "<html><head><title>T</title><script>var a='</p>';</script><style>p{}</style></head><body><header><h1>Site</h1></header>"
    "<nav><ul><li><a href='/'>Home</a></ul></nav><div class='cookie-notice'>We use cookies</div><main><article><header>"
    "<h1>Ti<b>tle</b></h1></header><p>One &amp; two&nbsp;x<br>three<p>Four<ul><li>a<li>b</ul><aside>side</aside>"
    "<section id='comments'><p>user says</p></section><form>Go</form></article></main><div id='sidebar'>x</div><footer>f</footer>"
)


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, low int, node int"
    data = [(1, "http://a.example/x", PAGE), (2, None, PAGE), (3, "http://a.example/", None), (4, "not a url", ""), (1, "http://a.example/x", PAGE),
            (5, "http://[bad", "<p>x" * 3), (None, "http://b.example/", "<article>y &lt;z&gt; &am"), (6, None, "<div>" * 3000 + "deep"),
            (7, None, "<p " + "a='" * 3000), (8, None, "<article>" + "<p>word</p>" * 30_000)]
    df = spark.createDataFrame([(*r, "t", 1, 2, 3) for r in data], schema)
    got = html.html_text(df).collect()
    assert len(got) == len(data)
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert by_id[1] == ["Title One & two x three Four a b"] * 2
    assert by_id[2] == by_id[1][:1]
    assert by_id[3] == by_id[4] == [""]
    assert by_id[5] == ["x x x"]
    assert by_id[None] == ["y <z> &am"]
    assert by_id[6] == ["deep"]
    assert by_id[8] == [" ".join(["word"] * 30_000)]
    assert html.html_text(df.limit(0)).collect() == []


@pytest.mark.parametrize("limit", [html.BROADCAST_NODES, 0])
def test_the_style_tree_finds_what_all_pages_of_a_site_share(spark, limit):
    pages = [
        (i, f"http://h.example/{i}", f"<body><div class=x1><p>Home About</p></div><div class=x2><h2>{prose(i, 4)}</h2><p>{prose(i + 50, 30)}</p></div><div class=x3>All rights</div>")
        for i in range(12)
    ]
    got = html.html_text(spark.createDataFrame(pages, "page_id long, url string, html string"), limit).collect()
    for r in got:
        assert r.text == f"{prose(r.page_id, 4)} {prose(r.page_id + 50, 30)}"


def test_sample_pages_against_a_plain_reading(spark):
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in html.html_text(pages).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", raw[r.page_id], re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|br|h1)\b[^>]*>", " ", body))
        assert r.text == " ".join(unescape(body).split())
