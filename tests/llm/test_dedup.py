import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from lineweave.llm import exact_dedup as exact
from lineweave.llm import substring_dedup as sub
from lineweave.llm.components import connected_components
from lineweave.llm.simhash import ring_links, simhash, simhash_groups

from .conftest import rows


def plain_simhash(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups_of(fingerprints, bits=2):
    """Root of each distinct fingerprint, by comparing all pairs."""
    parent = {f: f for f in fingerprints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = sorted(parent)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    return {f: find(f) for f in values}


def test_fingerprints_combine():
    rng = random.Random(1)
    text = rng.randbytes(3 * exact.CHUNK + 17)
    pieces = [text[i : i + exact.CHUNK] for i in range(0, len(text), exact.CHUNK)]
    whole = (0, 0, 0)
    for piece in pieces:
        fp = int(exact.fingerprints(np.frombuffer(piece, np.uint8), np.array([0, len(piece)]))[0])
        whole = exact.combine(whole, (fp >> 31, fp & (2**31 - 1), len(piece)))
    fp = int(exact.fingerprints(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0])
    assert (whole[0] << 31 | whole[1], whole[2]) == (fp, len(text))
    values = [0, 0]
    for byte in text[:1000]:
        values = [(v * r + byte + 1) % p for v, r, p in zip(values, exact.BASES, exact.PRIMES, strict=True)]
    assert int(exact.fingerprints(np.frombuffer(text[:1000], np.uint8), np.array([0, 1000]))[0]) == values[0] << 31 | values[1]


def test_exact_dedup(docs):
    got = exact.exact_dedup(docs).collect()
    by_text = defaultdict(list)
    for i, t, *_ in rows():
        by_text[t or ""].append(i)
    want = []
    for text, ids in by_text.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted(map(str, [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got])) == sorted(map(str, want))


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    data = [(i, f"{'abc'[i % 3]}" * 2000) for i in range(1, 1300)] + [(5000, "a" * 1999 + "b")]

    def sign(batches):
        import pyarrow as pa

        for batch in exact_sign(batches):
            yield batch.set_column(2, "fp", pa.array([7] * batch.num_rows, pa.int64()))

    exact_sign = exact._sign
    monkeypatch.setattr(exact, "_sign", sign)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: (5000, 1) if i == 5000 else (max(j for j, t in data if t == text), 433) for i, text in data}


def test_repeated_rows_are_chunked_once(spark, monkeypatch):
    repeated = [(7, "one text", 0)] * 4000 + [(None, "another text", 0)] * 3000 + [(8, "one text", 0), (9, "", 0)]
    df = spark.createDataFrame(repeated, "doc_id long, text string, fp int").repartition(6)
    chunked = spark.sparkContext.accumulator(0)
    chunk_batch = exact._chunk_batch

    def count(rows):
        chunked.add(len(rows))
        return chunk_batch(rows)

    monkeypatch.setattr(exact, "_chunk_batch", count)
    got = exact.exact_dedup(df).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.doc_id, r.keep_id, r.group_size, r.kept] += 1
    assert sizes == {(7, 8, 4001, False): 4000, (8, 8, 4001, True): 1, (None, None, 3000, True): 3000, (9, 9, 1, True): 1}
    # a lead for every PER_SALT rows of its group, and each other id with its text once
    assert chunked.value <= 2 + 4001 // exact.PER_SALT + 1 + 3000 // exact.PER_SALT + 1


@pytest.mark.parametrize("function", [exact.exact_dedup, simhash_groups, sub.substring_report])
def test_empty_tables(no_docs, function):
    assert function(no_docs).collect() == []


def test_simhash_of_a_long_text_in_windows(monkeypatch):
    from lineweave.llm import simhash as module

    text = " ".join(f"w{i % 97} X{i}" for i in range(3000))
    whole = simhash(text.encode())
    monkeypatch.setattr(module, "WINDOW", 100)
    assert simhash(text.encode()) == whole == plain_simhash(text)
    assert simhash(b"") == simhash(b" \n") == 0
    assert simhash(b"One") == plain_simhash("one")


def test_simhash_groups(docs):
    got = simhash_groups(docs).collect()
    prints = [(i, plain_simhash(t)) for i, t, *_ in rows()]
    roots = groups_of({f for _, f in prints})
    least = {}
    for i, f in prints:
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    want = sorted(str((i, f"{f:016x}", least.get(roots[f]))) for i, f in prints)
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want


@pytest.mark.parametrize(("bits", "bucket"), [(2, 48), (2, 1), (1, 48), (1, 1), (0, 48)])
def test_links_join_all_that_are_near(spark, bits, bucket):
    rng = random.Random(bits)
    prints = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(6):
            prints.add(f)
            for _ in range(rng.randrange(1, 4)):
                f ^= 1 << rng.randrange(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in prints], "fp long")
    links = ring_links(df, bits, bucket).collect()
    parent = {signed(f): signed(f) for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert a != b
        parent[find(a)] = find(b)
    want = {signed(f): signed(r) for f, r in groups_of(prints, bits).items()}
    classes = lambda root: sorted(sorted(x for x in want if root(x) == r) for r in {root(x) for x in want})
    assert classes(find) == classes(want.get)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


CAPITALS = "A-ZÀ-ÖØ-ÞΑ-ΩА-Я"
WIDE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"


def plain_words(text):
    return re.findall(rf"[{WIDE}]|[^\W{WIDE}]+", text)


def plain_units(text):
    """(start, end, key, words) of the units of a text, from the description and by regular expressions only."""
    places = [(m.end(), m.end()) for m in re.finditer("[。！？]", text)]
    one_capital = re.compile(rf"[{CAPITALS}](?![{CAPITALS}])")
    for m in re.finditer(r"\s+", text):
        capital = one_capital.match(text, m.end())
        if capital or text[m.start() - 1 : m.start()] in list(".!?") or re.search(r"[\r\n]", m[0]):
            places.append((m.start(), m.end()))
    at, before, out = 0, "", []
    for a, b in [*sorted(places), (len(text), len(text))]:
        start, at = at, max(at, b)
        if a <= start:
            continue
        pieces = [(start, a)]
        if len(plain_words(text[start:a].lower())) > 64:
            found = list(re.finditer(rf"[{WIDE}]|[^\W{WIDE}]+", text[start:a]))
            edges = [start + m.start() for m in found[1:] if xxhash.xxh32(m[0].lower().encode()).intdigest() % 8 == 0]
            pieces = list(zip([start, *edges], [*edges, a], strict=True))
        for x, y in pieces:
            words = plain_words(text[x:y].lower())
            if words:
                norm = " ".join(words)
                count = len(words) - len(re.findall(f"[{WIDE}]", text[x:y])) // 2
                out.append((x, y, norm if len(words) > 2 else before + "|" + norm, count))
                before = norm
    return out


def plain_substring(data, min_words=sub.SPARED_BELOW):
    """(id, what stays, spans that go)."""
    order = sorted(set(data), key=lambda r: (sub.NULL_ID if r[0] is None else r[0], xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))
    seen, later = set(), set()
    for i, text in order:
        for n, unit in enumerate(plain_units(text or "")):
            if unit[2] in seen:
                later.add((i, text, n))
            seen.add(unit[2])
    out = []
    for i, text in data:
        found, run, gone = plain_units(text or ""), [], []
        for n, unit in enumerate([*found, None]):
            if unit and (i, text, n) in later:
                run.append(unit)
            elif run:
                if sum(u[3] for u in run) >= min_words:
                    gone.append((run[0][0], re.compile(r"\s*").match(text, run[-1][1]).end()))
                run = []
        edges = [0, *[x for span in gone for x in span], len(text or "")]
        stays = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if gone else text
        out.append((i, stays, gone))
    return out


@pytest.mark.parametrize("min_words", [1, sub.SPARED_BELOW])
def test_substring_dedup(spark, docs, min_words):
    found = sub.substring_report(docs, min_words).collect()
    data = [r[:2] for r in rows()]
    originals = {}
    for i, t in data:
        originals.setdefault(i, []).append(t or "")
    for r in found:
        # the text is the original without what is removed, and its kept spans put together
        assert any(
            r.text == "".join(t[s.start : s.end] for s in r.kept)
            and sum(s.end - s.start for s in [*r.kept, *r.removed]) == len(t)
            for t in originals[r.doc_id]
        )
    got = [(r.doc_id, r.text, [(s.start, s.end) for s in r.removed]) for r in found]
    want = [(i, t or "", gone) for i, t, gone in plain_substring(data, min_words)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    # the copy goes, the first one and the upper-case form of it: same words, so it goes too
    left = {i: t for i, t, _ in got}
    assert left[1]
    assert left[2] == ""
    assert left[3] == ""


def test_substring_dedup_of_the_sample(spark):
    data = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = sub.substring_dedup(df).collect()
    want = plain_substring(data, 1)
    assert sorted((r.doc_id, r.text, [tuple(s) for s in r.removed]) for r in got) == sorted(want)


def test_passages_without_marks_are_found(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(80))
    wide = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(160))
    texts = []
    for i in range(6):
        here = passage if i % 2 else wide
        texts.append((i, " ".join(word() for _ in range(60)) + f" {here} " + " ".join(word() for _ in range(60))))
    got = {r.doc_id: r for r in sub.substring_report(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, text in texts:
        gone = sum(s.end - s.start for s in got[i].removed)
        assert (gone == 0) if i < 2 else (gone > 0.4 * len(passage if i % 2 else wide)), text


def test_a_pasted_passage_is_cut_out_of_the_middle_of_lines(spark):
    passage = "Once upon a time there lived a fisherman. He rowed out every day before dawn. " * 1 + (
        "Nobody knew what he looked for between the rocks. At night he mended nets by the fire and sang songs "
        "that his mother had taught him. One winter the sea froze as far as anyone could see."
    )
    a = f"First words of the host text here {passage} and then it goes on."
    b = f"Quite another beginning\nof two lines {passage} with another end. Short. End."
    c = "Nothing of this is anywhere else. It is left alone. Short. End."
    got = {r.doc_id: r for r in sub.substring_report(spark.createDataFrame([(1, a), (2, b), (3, c)], "doc_id long, text string")).collect()}
    assert got[1].text == a
    assert got[3].text == c
    assert [b[s.start : s.end] for s in got[2].removed] == [passage + " "]
    assert got[2].text == "Quite another beginning\nof two lines with another end. Short. End."
    assert got[2].source_ids == [1]


def test_short_units_count_with_the_one_before():
    assert len(set(sub.digests("One two three. No. Four five six. No.")[1])) == 4
    assert sub.digests("...")[1] == []
