"""Groups of near-equal texts: SimHash with pigeonring filtering, decided by similarity of 5-word shingles.

This is the form of the SimHash operator for a given similarity.  At a Jaccard similarity of 0.8, 64-bit
fingerprints differ in up to 12 bits (measured on the sample texts), where segments of them tell hardly any two
texts apart.  So the fingerprint is wider, 1,152 bits and more: every different shingle of a text votes on every bit,
for or against, and a bit is set if more are for it.  Two texts with a similarity of 0.8 differ in 15 % of the bits
on average, and texts that differ in more than a quarter (9 deviations above) are not compared.

The bits are a ring of segments.  If two fingerprints differ in t of m segments' bits or fewer, some start exists from
which every run of l consecutive segments has at most l * t / m differences (pigeonring).  Starts whose first segment
has no difference are taken: the segment is the join key.  Inside a key, the longer runs prune the pairs by the bits
that follow, which travel with it; and the full Hamming check and the shingle sets decide.  There are so many segments
that texts with a similarity of 0.8 have 13 such starts on average.  Segments get wider with the number of texts.

Pairs that pass the runs are joined to groups; every task joins its pairs to stars first, so that a group of near copies
does not have links of its own for every key.  Runs let some texts pass that are not near, and a group may chain many of
them.  So groups of more than HELD are divided first, by the full Hamming check of their fingerprints, with a hub's and,
for what is not like the hub, chunk by chunk, which moves no text.  Then every text of a group comes to it once; texts of no group do not move.

The texts of a group of up to HELD come together in one task, which walks its components breadth first: a text that is
linked is not compared again.  Larger groups are never held by a task.  Their texts are dealt into chunks and compared
with one of them, the hub, which links a group of near copies in one linear pass; what is not near the hub is compared
with what is, chunk by chunk, and then gets a hub of its own, HUBS times; what is left then is compared chunk by chunk.
Both ways give links enough to join all that is near, and never all pairs.

Words are those of the SimHash operator (ASCII white space, ASCII lower case).  Defined results: a text of fewer than
WORDS words is one shingle; texts without words are equal to each other; a null text counts as empty; repeated rows
are one text; null ids keep their rows and never name a component unless all ids of it are null; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (
    durable, expect_columns, join_hot, marked_rows, mix64, row_windows, string_bytes, stored, text_or_empty, token_spans, trimmed, word_hashes,
)
from .components import connected_components, name_components

WORDS = 5
SIMILARITY = 0.8
#: Bits of a segment at least, and texts that meet by chance in one (as a power of two) before it gets wider.
WIDTH, MEET = 12, 9
#: Starts without a difference that texts at the similarity have on average.
STARTS = 13.3
#: Parts of a fingerprint whose votes are independent.
PARTS = 4
#: The share of differing bits up to which texts are compared.
BUDGET = 1 / 4
#: Texts of a key among which all pairs are looked at at once.
PAIRED = 512
#: Texts of a group that a task holds, and of a chunk of a larger one; hubs of a larger group.
HELD, CHUNK, HUBS = 2000, 500, 3
#: Fingerprints of a larger group that a task holds, and chunks of so many that pass them.
PRINTS, PASSING = 2048, 16
#: Links that a task holds to join them to stars.
LINKS = 1 << 17
#: Bytes and rows of text whose votes are counted at once.
STEP, ROWS = 1 << 18, 64

_PLACE = np.random.default_rng(6).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(buf: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingle hashes of all rows, repeats included, and the number of the first one of each row (one entry
    more than rows); every row has one at least."""
    starts, ends, first = token_spans(buf, offsets)
    h = word_hashes(buf, starts, ends)
    sizes = np.diff(first)
    counts = np.maximum(sizes - words + 1, 1)
    begin = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(sizes)), counts)
    at = first[row] + np.arange(begin[-1]) - begin[row]
    out = np.minimum(sizes, words)[row].astype(np.uint64)
    padded = np.append(h, np.zeros(words, dtype=np.uint64))
    short = sizes < words
    for k in range(words):
        value = padded[at + k] * _PLACE[k]
        if short.any():
            value[(short & (sizes <= k))[row]] = 0
        out += value
    return mix64(out), begin


@dataclass(frozen=True)
class Ring:
    """The bits of a fingerprint: so many segments of so many bits."""

    segments: int
    width: int

    @classmethod
    def of(cls, texts: int, similarity: float = SIMILARITY) -> Ring:
        width = max(WIDTH, max(texts, 1).bit_length() - MEET)
        equal = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
        return cls(max(2 * 60 // WIDTH + 1, math.ceil(STARTS / equal**width)), width)

    @property
    def bits(self) -> int:
        return self.segments * self.width

    @property
    def slots(self) -> int:
        """Different votes that there are for the bits of a part, a power of two: 1,024 or as many as bits."""
        return max(1 << 10, 1 << (-(-self.bits // PARTS) - 1).bit_length())

    @property
    def run(self) -> int:
        """Segments of half a chain: as many as fit a word."""
        return 60 // self.width

    def allowed(self, run: int) -> int:
        """Differing bits of a run of so many segments."""
        return int(run * self.width * BUDGET)


def _hadamard(n: int) -> np.ndarray:
    out = np.ones((1, 1), dtype=np.float32)
    while len(out) < n:
        out = np.block([[out, out], [out, -out]])
    return out


def simhashes(sets: list[np.ndarray], ring: Ring) -> np.ndarray:
    """The fingerprints (rows, bytes) of sets of shingles, each without repeats.

    A shingle votes on bit i of a part by the parity of its slot and the number of the bit, turned round by a sign of its
    own.  So votes of one slot are counted first, and one Walsh-Hadamard transform of the counts gives the sums of all
    bits.  Each part of the bits has slots and signs of its own, as shingles of one slot cannot be told apart there."""
    slots, size = ring.slots, -(-ring.bits // PARTS)
    width, order = slots.bit_length(), np.random.default_rng(9).permutation(slots)[:size]
    high = 1 << (width - 1) // 2
    left, right = _hadamard(high), _hadamard(slots // high)
    out = np.empty((len(sets), -(-ring.bits // 8)), dtype=np.uint8)
    for a in range(0, len(sets), ROWS):
        held = sets[a : a + ROWS]
        found = np.concatenate(held)
        row = np.repeat(np.arange(len(held)) * slots, [len(x) for x in held])
        bits = []
        for part in range(PARTS):
            own = (found >> np.uint64(part * width)).astype(np.int64)
            sign = 1.0 - 2.0 * (own & 1)
            votes = np.bincount(row + (own >> 1 & slots - 1), sign, len(held) * slots)
            sums = left @ votes.astype(np.float32).reshape(len(held), high, -1) @ right
            bits.append(sums.reshape(len(held), -1)[:, order] > 0)
        out[a : a + ROWS] = np.packbits(np.concatenate(bits, axis=1)[:, : ring.bits], axis=1)
    return out


def _distinct_shingles(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(number of the first row, shingles of each row without repeats) of blocks of rows."""
    buf, offsets = string_bytes(batch.column("text"))
    for a, b in row_windows(offsets, STEP):
        found, begin = shingles(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
        yield a, [np.unique(found[i:j]) for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def _sign(words: int, ring: Ring):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sets in _distinct_shingles(batch, words):
                prints = [r.tobytes() for r in simhashes(sets, ring)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, len(sets)), pa.array(prints, pa.binary())], names=["node", "ring"])

    return run


def _starts(ring: Ring):
    """One row per segment: its number and bits are the key, the bits of the segments that follow are in two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                prints = np.frombuffer(b"".join(part.column("ring").to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)
                bits = np.unpackbits(prints, axis=1, count=ring.bits).reshape(part.num_rows, ring.segments, ring.width)
                segments = bits @ (1 << np.arange(ring.width, dtype=np.int64))
                words = [
                    sum(np.roll(segments, -1 - first - j, axis=1) << (ring.width * j) for j in range(ring.run)).ravel()
                    for first in (0, ring.run)
                ]
                keys = segments * ring.segments + np.arange(ring.segments)
                nodes = np.repeat(part.column("node").to_numpy(), ring.segments)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.ravel(), nodes, *words)], names=["k", "node", "c", "d"])

    return run


def chain_links(c: np.ndarray, d: np.ndarray, ring: Ring) -> list[tuple[int, int]]:
    """Pairs of numbers of rows whose runs are within their budgets, enough to join all that are."""
    short, long = ring.allowed(1 + ring.run), ring.allowed(1 + 2 * ring.run)
    if len(c) <= PAIRED:
        first = np.bitwise_count(c[:, None] ^ c)
        x, y = np.nonzero(first <= short)
        x, y = x[x < y], y[x < y]
        near = first[x, y].astype(np.int64) + np.bitwise_count(d[x] ^ d[y]) <= long
        if near.sum() <= 2 * len(c):
            return list(zip(x[near].tolist(), y[near].tolist(), strict=True))
    found, queue, left = [], [0], np.arange(1, len(c))
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
            continue
        x = queue.pop()
        first = np.bitwise_count(c[left] ^ c[x])
        gone = (first <= short) & (first.astype(np.int64) + np.bitwise_count(d[left] ^ d[x]) <= long)
        new = left[gone].tolist()
        found.extend((x, y) for y in new)
        queue.extend(new)
        left = left[~gone]
    return found


def stars(links: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that join the same numbers: each of a component with its smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        above = parent.setdefault(x, x)
        while above != x:
            parent[x] = parent[above]
            x, above = above, parent[above]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(r, x) for x in sorted(parent) if (r := root(x)) != x]


def _pairs_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], names=["a", "b"])


def _bounded(found: set[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Joins what is held to stars where it is too much, and gives them away where they still are many."""
    if len(found) > LINKS:
        joined = stars(found)
        found.clear()
        if len(joined) > LINKS // 2:
            yield _pairs_batch(joined)
        else:
            found.update(joined)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join the same texts, as stars of what a task reads."""
    found: set[tuple[int, int]] = set()
    for batch in batches:
        found.update(zip(*(batch.column(c).to_pylist() for c in ("a", "b")), strict=True))
        yield from _bounded(found)
    yield _pairs_batch(stars(found))


def _groups(links: DataFrame) -> DataFrame:
    """(k, node) of the components of ``links`` (a, b); the tasks that read them are fewer than those that found them."""
    joined = stored(links).mapInArrow(trimmed(_joined), "a long, b long")
    return connected_components(joined).select(F.col("root").alias("k"), "node")


def _candidates(ring: Ring):
    """Rows come by key: links (a, b) that join all texts whose runs are within their budgets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        found: set[tuple[int, int]] = set()

        def links(last: bool) -> list[list[np.ndarray]]:
            k, node, c, d = (np.concatenate(x) for x in zip(*kept, strict=True))
            cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
            whole = cuts if last else cuts[:-1]
            at = np.flatnonzero(np.diff(whole) > 1)
            for a, b in zip(whole[at].tolist(), whole[at + 1].tolist(), strict=True):
                own = node[a:b]
                found.update((int(own[x]), int(own[y])) for x, y in chain_links(c[a:b], d[a:b], ring))
            rest = whole[-1]
            return [] if last else [[k[rest:], node[rest:], c[rest:], d[rest:]]]

        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append([batch.column(n).to_numpy() for n in ("k", "node", "c", "d")])
            if kept[0][0][-1] != kept[-1][0][-1]:
                kept = links(False)
                yield from _bounded(found)
        if kept:
            links(True)
        yield _pairs_batch(stars(found))

    return run


def within_budget(differing: np.ndarray) -> np.ndarray:
    """The full Hamming check: whether so many of the bits of each row (rows, bytes) are set at most."""
    return np.bitwise_count(differing).sum(axis=1, dtype=np.int64) <= BUDGET * 8 * differing.shape[1]


def near_pairs(
    sets: list[np.ndarray], similarity: float, rings: np.ndarray | None = None
) -> Iterator[tuple[int, int]]:
    """Pairs of numbers of ``sets`` (each without repeats) that are as similar, enough to join all that are.

    With ``rings``, only sets whose fingerprints are within the budget are compared."""
    sizes = np.array([len(s) for s in sets])
    names = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    ends = np.cumsum(sizes)
    own = [names[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    flag = np.zeros(names.max() + 1, dtype=np.int64)
    left = np.arange(1, len(sets))
    queue = [0]
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
            continue
        x = queue.pop()
        close = np.minimum(sizes[x], sizes[left]) >= similarity * np.maximum(sizes[x], sizes[left]) - 1e-9
        if rings is not None:
            at = np.flatnonzero(close)
            close[at] = within_budget(rings[left[at]] ^ rings[x])
        at = np.flatnonzero(close)
        if not len(at):
            continue
        near = left[at]
        flag[own[x]] = 1
        both = np.add.reduceat(flag[np.concatenate([own[y] for y in near.tolist()])], np.cumsum(sizes[near]) - sizes[near])
        flag[own[x]] = 0
        gone = np.zeros(len(left), dtype=bool)
        gone[at] = both >= similarity * (sizes[x] + sizes[near] - both) - 1e-9
        for y in left[gone].tolist():
            yield x, y
            queue.append(y)
        left = left[~gone]


def _link(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, rings = None, [], [], []
        found: list[tuple[int, int]] = []

        def settle() -> None:
            if len(sets) > 1:
                ring = np.frombuffer(b"".join(rings), dtype=np.uint8).reshape(len(sets), -1)
                found.extend((nodes[x], nodes[y]) for x, y in near_pairs(sets, similarity, ring))

        def out() -> pa.RecordBatch:
            batch = _pairs_batch(found)
            found.clear()
            return batch

        for batch in batches:
            buf, offsets = string_bytes(batch.column("text"))
            rows = zip(*(batch.column(c).to_pylist() for c in ("k", "node", "ring")), strict=True)
            for i, (k, node, ring) in enumerate(rows):
                if k != key:
                    settle()
                    key, nodes, sets, rings = k, [], [], []
                    if len(found) > 10_000:
                        yield out()
                part = buf[offsets[i] : offsets[i + 1]]
                nodes.append(node)
                rings.append(ring)
                sets.append(np.unique(shingles(part, np.array([0, len(part)]), words)[0]))
        settle()
        yield out()

    return run


def _near_ones(own: np.ndarray, ring: np.ndarray, sets: list[np.ndarray], rings: np.ndarray, similarity: float) -> np.ndarray:
    """Which of ``sets`` are as similar to ``own``."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    near = np.minimum(len(own), sizes) >= similarity * np.maximum(len(own), sizes) - 1e-9
    at = np.flatnonzero(near)
    near[at] = within_budget(rings[at] ^ ring)
    for i in np.flatnonzero(near).tolist():
        both = len(np.intersect1d(own, sets[i], assume_unique=True))
        near[i] = both >= similarity * (len(own) + len(sets[i]) - both) - 1e-9
    return near


def _rows(batch: pa.RecordBatch, words: int, place: list[str]) -> Iterator[tuple[tuple, int, int, np.ndarray, np.ndarray]]:
    """(place, side, node, shingles, ring) of the rows of a batch."""
    buf, offsets = string_bytes(batch.column("text"))
    columns = zip(*(batch.column(c).to_pylist() for c in (*place, "side", "node", "ring")), strict=True)
    for i, (*here, side, node, ring) in enumerate(columns):
        part = buf[offsets[i] : offsets[i + 1]]
        own = np.unique(shingles(part, np.array([0, len(part)]), words)[0])
        yield tuple(here), side, node, own, np.frombuffer(ring, dtype=np.uint8)


def _from_hub(words: int, similarity: float):
    """Rows come by bucket and chunk, the hub first: whether each text is near its hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: tuple = ()
        for batch in batches:
            found = []
            for (k, _), side, node, own, ring in _rows(batch, words, ["k", "salt"]):
                if not side:
                    hub = node, own, ring
                else:
                    near = _near_ones(hub[1], hub[2], [own], ring[None, :], similarity)
                    found.append((k, hub[0], node, bool(near[0])))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            columns = [pa.array([r[i] for r in found], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "hub", "node", "near"])

    return run


def _tile(words: int, similarity: float):
    """Rows come by bucket and chunks, those of the held chunk first: links of the others to it, one for each of the
    groups that are near within the chunk, and the links of these groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, rings = None, [], [], []
        groups = table = None
        for batch in batches:
            found = []
            for here, side, node, own, ring in _rows(batch, words, ["k", "right", "left"]):
                if here != key:
                    key, nodes, sets, rings, groups = here, [], [], [], None
                if not side:
                    nodes.append(node)
                    sets.append(own)
                    rings.append(ring)
                    continue
                if not nodes:
                    continue
                if groups is None:
                    table = np.stack(rings)
                    groups = np.arange(len(nodes))
                    for x, y in near_pairs(sets, similarity, table):
                        groups[y] = groups[x]
                        found.append((nodes[x], nodes[y]))
                near = np.flatnonzero(_near_ones(own, ring, sets, table, similarity))
                _, first = np.unique(groups[near], return_index=True)
                found.extend((node, nodes[i]) for i in near[first].tolist() if nodes[i] != node)
            yield _pairs_batch(stars(found))

    return run


def _words(rings: list[bytes]) -> np.ndarray:
    """Fingerprints as rows of 64-bit words, with zeros at the end."""
    size = -(-len(rings[0]) // 8) * 8
    return np.frombuffer(b"".join(r.ljust(size, b"\0") for r in rings), dtype=np.uint64).reshape(len(rings), -1)


def _print_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by group and chunks, those of the held chunk first: links that join all texts, of the held chunk or one of
    it and one of the others, whose fingerprints are within the budget."""
    key, nodes, rings = None, [], []
    groups = table = None
    for batch in batches:
        found = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("k", "right", "left", "side", "node", "ring")), strict=True)
        for k, right, left, side, node, ring in rows:
            if (k, right, left) != key:
                key, nodes, rings, groups = (k, right, left), [], [], None
            if not side:
                nodes.append(node)
                rings.append(ring)
                continue
            if not nodes:
                continue
            most = BUDGET * 8 * len(ring)
            if groups is None:
                table, groups = _words(rings), np.full(len(nodes), -1)
                for i in range(len(nodes)):
                    queue = [i] if groups[i] < 0 else []
                    groups[queue] = i
                    while queue:
                        x, rest = queue.pop(), np.flatnonzero(groups < 0)
                        new = rest[np.bitwise_count(table[rest] ^ table[x]).sum(axis=1, dtype=np.int64) <= most]
                        groups[new] = i
                        queue.extend(new.tolist())
                        found.extend((nodes[i], nodes[y]) for y in new.tolist())
            near = np.bitwise_count(table ^ _words([ring])).sum(axis=1, dtype=np.int64) <= most
            found.extend((node, nodes[i]) for i in np.unique(groups[near]).tolist() if nodes[i] != node)
        yield _pairs_batch(stars(found))


def _like_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds whether the fingerprint of each row is within the budget of its hub's."""
    for batch in batches:
        own, hub = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("ring", "hub_ring")
        )
        near = within_budget(own ^ hub) if batch.num_rows else np.zeros(0, dtype=bool)
        columns = [batch.column(c) for c in ("k", "hub", "node", "ring")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(near)], names=["k", "hub", "node", "ring", "near"])


def divided(members: DataFrame, prints: DataFrame) -> DataFrame:
    """(k, node): the groups ``members`` (k, node) divided into those that fingerprints within the budget join, directly or
    by a chain; texts alone are left out.  ``prints`` is (node, ring).

    One linear pass links what is like a hub; only the others are compared, with all, chunk by chunk."""
    hubs = stored(members.groupBy("k").agg(F.min("node").alias("hub"), F.count("*").alias("n")))
    whole = stored(join_hot(members, hubs, ["k"], "n").select("k", "hub", "node").join(prints, "node"))
    # a large group has HELD texts at least, so hubs are few
    of_hubs = F.broadcast(whole.where("node = hub").select("k", F.col("ring").alias("hub_ring")))
    seen = stored(
        whole.join(of_hubs, "k").select("k", "hub", "node", "ring", "hub_ring").mapInArrow(
            trimmed(_like_hub), "k long, hub long, node long, ring binary, near boolean"
        )
    )
    sizes = stored(
        seen.groupBy("k").agg(F.count("*").alias("n_left"), F.count_if(~F.col("near")).alias("n_right")).where("n_right > 0").select(
            "*", F.ceil(F.col("n_left") / (PASSING * PRINTS)).alias("lefts"), F.ceil(F.col("n_right") / PRINTS).alias("rights")
        )
    )
    held = join_hot(seen.where("NOT near"), sizes, ["k"], "n_right").select(
        "k", "node", "ring", _chunk_of(F.col("rights")).alias("right"), _upto(F.col("lefts")).alias("left"), F.lit(0).alias("side")
    )
    passing = join_hot(seen, sizes, ["k"], "n_left").select(
        "k", "node", "ring", _upto(F.col("rights")).alias("right"), _chunk_of(F.col("lefts")).alias("left"), F.lit(1).alias("side")
    )
    place = ["k", "right", "left"]
    dealt = held.unionByName(passing).repartition(*place).sortWithinPartitions(*place, "side", "node")
    links = dealt.select(*place, "side", "node", "ring").mapInArrow(trimmed(_print_tile), "a long, b long")
    return _groups(links.unionByName(seen.where("near AND node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))))


def _chunk_of(chunks: Column) -> Column:
    return F.pmod(F.xxhash64("node"), chunks)


def _upto(chunks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))


def _tiles(left: DataFrame, right: DataFrame, whole: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links between the texts ``left`` and ``right`` (k, node) of each bucket, chunk by chunk."""
    number = lambda rows, name: rows.groupBy("k").agg(F.count("*").alias(name))
    sizes = stored(
        number(left, "n_left").join(number(right, "n_right"), "k").select(
            "*", F.ceil(F.col("n_left") / (8 * CHUNK)).alias("lefts"), F.ceil(F.col("n_right") / CHUNK).alias("rights")
        )
    )
    held = join_hot(right, sizes, ["k"], "n_right").select(
        "k", "node", _chunk_of(F.col("rights")).alias("right"), _upto(F.col("lefts")).alias("left"), F.lit(0).alias("side")
    )
    passing = join_hot(left, sizes, ["k"], "n_left").select(
        "k", "node", _upto(F.col("rights")).alias("right"), _chunk_of(F.col("lefts")).alias("left"), F.lit(1).alias("side")
    )
    place = ["k", "right", "left"]
    dealt = held.unionByName(passing).join(whole, "node").repartition(*place).sortWithinPartitions(*place, "side")
    return stored(
        dealt.select(*place, "side", "node", "text", "ring").mapInArrow(trimmed(_tile(words, similarity)), "a long, b long").distinct()
    )


def hot_links(members: DataFrame, whole: DataFrame, similarity: float, words: int) -> DataFrame:
    """Links that join all texts of ``members`` (k, node) that are near; ``whole`` has their texts and rings."""
    whole, links = stored(_of(whole, members)), []
    for _ in range(HUBS):
        hubs = stored(members.groupBy("k").agg(F.min("node").alias("hub"), F.count("*").alias("n")))
        chunks = F.ceil(F.col("n") / CHUNK)
        others = join_hot(members, hubs, ["k"], "n").where("node <> hub")
        others = others.select("k", "node", _chunk_of(chunks).alias("salt"), F.lit(1).alias("side"))
        copies = hubs.select("k", F.col("hub").alias("node"), _upto(chunks).alias("salt"), F.lit(0).alias("side"))
        dealt = copies.unionByName(others).join(whole, "node").repartition("k", "salt").sortWithinPartitions("k", "salt", "side")
        seen = stored(
            dealt.select("k", "salt", "side", "node", "text", "ring").mapInArrow(
                trimmed(_from_hub(words, similarity)), "k long, hub long, node long, near boolean"
            )
        )
        links.append(seen.where("near").select(F.col("hub").alias("a"), F.col("node").alias("b")))
        members = seen.where("NOT near").select("k", "node")
        if members.isEmpty():
            break
        links.append(_tiles(seen.where("near").select("k", "node"), members, whole, words, similarity))
    else:
        links.append(_tiles(members, members, whole, words, similarity))
    return reduce(DataFrame.unionByName, links)


def _of(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The rows whose node is one of ``members``; hardly any others move."""
    nodes = members.select("node")
    return marked_rows(rows, nodes, "node")[0].join(nodes, "node", "left_semi")


def _large(groups: DataFrame) -> DataFrame:
    """(k, size) of the groups (k, node) that are too large for a task."""
    return stored(groups.groupBy("k").agg(F.count("*").alias("size")).where(F.col("size") > HELD))


def near_links(texts: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """Links (a, b) that join all nodes of ``texts`` (node, text) that are near, directly or by a chain; rows of one
    node have one text."""
    ring = Ring.of(texts.count(), similarity)
    prints = stored(texts.mapInArrow(trimmed(_sign(words, ring)), "node long, ring binary").dropDuplicates(["node"]))
    # in the order of nodes, so that the links of many keys are the same
    starts = prints.mapInArrow(_starts(ring), "k long, node long, c long, d long").repartition("k").sortWithinPartitions("k", "node")
    meet = stored(_groups(starts.mapInArrow(trimmed(_candidates(ring)), "a long, b long")))
    hot = _large(meet)
    if not hot.isEmpty():
        parts = divided(stored(join_hot(meet, hot, ["k"], "size").select("k", "node")), _of(prints, meet))
        meet = stored(meet.join(F.broadcast(hot), "k", "left_anti").unionByName(parts))
        hot = _large(meet)
    whole = stored(_of(texts, meet).dropDuplicates(["node"]).select("node", "text").join(_of(prints, meet), "node"))
    small = meet.join(F.broadcast(hot), "k", "left_anti")
    dealt = small.join(whole, "node").repartition("k").sortWithinPartitions("k", "node")
    links = dealt.select("k", "node", "text", "ring").mapInArrow(trimmed(_link(words, similarity)), "a long, b long")
    if not hot.isEmpty():
        members = stored(join_hot(meet, hot, ["k"], "size").select("k", "node"))
        links = links.unionByName(hot_links(members, whole, similarity, words))
    return durable(links)


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): component_id and text_key (xxhash64 of the text)."""
    rows = expect_columns(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("node"), text_or_empty().alias("text")
    )
    ids = stored(rows.select("doc_id", "node"))
    least = stored(ids.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    linked = connected_components(near_links(rows.select("node", "text"), similarity, words))
    named = stored(
        least.join(name_components(linked, least, "first"), "node", "left").select(
            "node", F.coalesce("component", "first").alias("component_id"), "n"
        )
    )
    return join_hot(ids, named, ["node"], "n").select("doc_id", "component_id", F.col("node").alias("text_key"))
