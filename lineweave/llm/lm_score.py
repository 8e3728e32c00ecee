"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(subclass | class, history) * P(word | class, subclass).

* Classes: each of the SINGLES most frequent words and the end of the text are classes of their
  own; all other words, unknown ones included, fall into GROUPS classes by a hash of their ending, and in each of
  these into SUBS subclasses by a hash of the word.
* P(class | history) is a softmax over hashed features of the history: the bigram context (last
  word), the trigram context (last two), and the skip features (word before the last, and the one
  before that).  P(subclass | class, history) is one over features of the class with the bigram context and with the
  first skip context.  Their weights grow with the corpus: ``buckets`` for each feature, a power of two near the number of
  training tokens over TOKENS_A_BUCKET, from LEAST to MOST (MOST is reached at about 4 GB of text: every task holds
  the weights, so they must end somewhere; the counts below do not).
* The weights are trained by distributed updates: the training texts are dealt into ROUNDS parts, and in each round
  every task sums observed and expected class counts per feature over its texts (the gradient is their
  difference); the sums meet in a tree in double precision, and the step is
  RATE * log(observed / expected), the damped, preconditioned gradient step of iterative scaling.  A text takes part in
  one round; all texts take part in the counts.
* P(word | class, subclass) is estimated from all training counts with an absolute discount per class, whose
  mass goes to unknown words; so the model is a distribution over the known words and "unknown".

The counts of the TOP most frequent words go to every task (a table of fixed size); rarer words
of a text are joined with the whole table of counts.  Word identity is a 64-bit hash.

Defined results: a null text counts as empty (one token, the end); a null id counts as the empty
text when folds are dealt; repeated rows get equal results each; very long texts are scored in windows of whole rows; ties
in frequency go to the smaller hash; other columns are ignored; without training texts every word
is unknown and N is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, expect_columns, id_remainder, mix64, row_windows, stored, string_bytes, token_spans, trimmed, word_hashes

SINGLES = 15
GROUPS = 16
CLASSES = SINGLES + GROUPS + 1
END_CLASS = CLASSES - 1
END = np.uint64(0x5DEECE66D2545F49)
SUBS = 32
#: Features of the class: contexts of ``contexts``; those of the subclass, with that many buckets times SUB_BUCKETS.
FEATURES = 4
SUB_FEATURES = (0,)
SUB_BUCKETS = 4
LEAST, MOST = 1 << 10, 1 << 14
TOKENS_A_BUCKET = 32_768
ROUNDS = 4
RATE = 0.35
SMOOTH = 2.0
TOP = 1 << 18
FOLDS, HELD = 7, 2
#: Tokens whose class scores are computed at once.
STEP = 8192
BLOCKS = 16
#: Training tokens of a task of the gradient, if there are more than the cores take at once.
TOKENS_A_TASK = 1 << 28
NULL_ID = -(1 << 63)
_LOWER = np.frombuffer(LOWER_BYTES, dtype=np.uint8)
_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


@dataclass
class Tokens:
    """The tokens of some texts, each text closed by END: hashes, spelling groups (-1: the end) and first tokens."""

    hashes: np.ndarray
    groups: np.ndarray
    first: np.ndarray


def tokenize(buf: np.ndarray, offsets: np.ndarray) -> Tokens:
    starts, ends, first = token_spans(buf, offsets)
    n = len(offsets) - 1
    last = _LOWER[buf[ends - 1]].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    second = np.where(ends - starts > 1, _LOWER[buf[np.maximum(ends - 2, 0)]] if len(ends) else 0, 0).astype(np.uint64)
    spelled = (mix64(last << np.uint64(8) | second) % np.uint64(GROUPS)).astype(np.int8)
    place = np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))
    hashes = np.full(len(starts) + n, END, dtype=np.uint64)
    groups = np.full(len(starts) + n, -1, dtype=np.int8)
    hashes[place] = word_hashes(buf, starts, ends)
    groups[place] = spelled
    return Tokens(hashes, groups, first[:-1] + np.arange(n))


def contexts(tokens: Tokens) -> list[np.ndarray]:
    """The FEATURES contexts of every token: last word, last two, word before the last, the one before that."""
    h, first = tokens.hashes, tokens.first
    size = np.diff(np.append(first, len(h)))
    back = []
    for distance in (1, 2, 3):
        old = np.full(len(h), np.uint64(distance), dtype=np.uint64)
        old[distance:] = h[:-distance] if distance < len(h) else old[distance:]
        for k in range(distance):
            old[(first + k)[size > k]] = np.uint64(distance)
        back.append(old)
    return [back[0], back[1] * _SALTS[1] + back[0], back[1], back[2]]


def features(context: list[np.ndarray], buckets: int) -> np.ndarray:
    """(FEATURES, tokens): rows of the weights of the classes that are active at each token."""
    shift = np.uint64(65 - buckets.bit_length())
    return np.stack(
        [((mix64(c * s) >> shift) + np.uint64(k * buckets)).astype(np.int64) for k, (c, s) in enumerate(zip(context, _SALTS, strict=True))]
    )


def sub_features(context: list[np.ndarray], classes: np.ndarray, buckets: int) -> np.ndarray:
    """The same for the weights of the subclasses, given the classes."""
    buckets *= SUB_BUCKETS
    shift = np.uint64(65 - buckets.bit_length())
    own = mix64(classes.astype(np.uint64) + np.uint64(1))
    return np.stack(
        [((mix64(context[c] * _SALTS[c] ^ own) >> shift) + np.uint64(k * buckets)).astype(np.int64) for k, c in enumerate(SUB_FEATURES)]
    )


def subclass(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(SUBS)).astype(np.int64)


class Index:
    """An open hash table from 64-bit hashes to 0..n-1."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.values = np.full(1 << bits, -1, dtype=np.int32)
        left, number = keys, np.arange(len(keys), dtype=np.int32)
        slot = (left >> self.shift).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, pick = np.unique(slot[free], return_index=True)
            seat = free[pick]
            self.keys[slot[seat]], self.values[slot[seat]] = left[seat], number[seat]
            rest = np.ones(len(left), dtype=bool)
            rest[seat] = False
            left, number, slot = left[rest], number[rest], (slot[rest] + 1) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> self.shift).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == hashes, self.values[slot], np.int32(-1))
        go = np.flatnonzero((held != hashes) & (held != 0))
        at = slot[go]
        while len(go):
            at = (at + 1) & self.mask
            held = self.keys[at]
            hit = held == hashes[go]
            out[go[hit]] = self.values[at[hit]]
            more = ~hit & (held != 0)
            go, at = go[more], at[more]
        return out


@dataclass
class Vocabulary:
    """What every task knows of the counts; all of bounded size.

    A leaf is a class, or a subclass of a spelled one: ``leaf_*`` have SINGLES single classes, GROUPS * SUBS
    subclasses and the end."""

    tokens: int
    types: int
    singles: np.ndarray
    top: np.ndarray
    top_counts: np.ndarray
    top_groups: np.ndarray
    class_tokens: np.ndarray
    leaf_tokens: np.ndarray
    leaf_types: np.ndarray
    discount: np.ndarray
    end_count: int

    @property
    def buckets(self) -> int:
        return min(MOST, max(LEAST, 1 << (self.tokens // TOKENS_A_BUCKET).bit_length()))

    def classes(self, tokens: Tokens, index: Index) -> np.ndarray:
        """Class of every token; ``index`` is over ``singles``."""
        single = index.find(tokens.hashes)
        spelled = np.where(tokens.groups < 0, END_CLASS, SINGLES + tokens.groups.astype(np.int64))
        return np.where((single >= 0) & (tokens.groups >= 0), single, spelled)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.types + 1))

    def unknown(self) -> np.ndarray:
        """log10 P(unknown | leaf)."""
        seen = np.maximum(self.leaf_tokens, 1)
        share = np.where(self.leaf_tokens > 0, self.discount[class_of_leaf()] * self.leaf_types / seen, 1.0)
        return np.log10(np.maximum(share, 1e-12))

    def known(self, counts: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """log10 P(word | leaf) of known words."""
        left = np.maximum(counts - self.discount[class_of_leaf()[leaves]], 1e-3)
        return np.log10(left / np.maximum(self.leaf_tokens[leaves], 1))


LEAVES = SINGLES + GROUPS * SUBS + 1


def leaves(classes: np.ndarray, subs: np.ndarray) -> np.ndarray:
    spelled = (classes >= SINGLES) & (classes != END_CLASS)
    return np.where(spelled, SINGLES + (classes - SINGLES) * SUBS + subs, np.where(classes == END_CLASS, LEAVES - 1, classes))


def class_of_leaf() -> np.ndarray:
    return np.concatenate([np.arange(SINGLES), SINGLES + np.repeat(np.arange(GROUPS), SUBS), [END_CLASS]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        hashes, groups, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(hashes[begin].view(np.int64)),
                pa.array(groups[order][begin].astype(np.int32)),
                pa.array(np.add.reduceat(counts[order], begin)),
            ],
            names=["h", "g", "n"],
        )

    for batch in batches:
        buf, offsets = string_bytes(batch.column("text"))
        for a, b in row_windows(offsets):
            tokens = tokenize(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            hashes, first, counts = np.unique(tokens.hashes, return_index=True, return_counts=True)
            held.append((hashes, tokens.groups[first], counts))
            size += len(hashes)
            if size > 2_000_000:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def count_words(train: DataFrame) -> DataFrame:
    """(h, g, n): every token of ``train`` (text) with its spelling group (-1: the end) and count."""
    return train.select("text").mapInArrow(trimmed(_count), "h long, g int, n long").groupBy("h").agg(
        F.max("g").alias("g"), F.sum("n").alias("n")
    )


def summarise(counts: DataFrame) -> Vocabulary:
    words = counts.where("g >= 0")
    # counts in bins of a sixteenth of an octave, the small ones by themselves: a few hundred rows
    grade = F.floor(F.log2("n") * 16).cast("int")
    room, least = TOP, None
    for row in sorted(words.groupBy(grade.alias("b")).count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = row["b"]
    # at most TOP rows, whole bins; no task sorts or gathers the table
    top = words.where(grade >= least if least is not None else F.lit(False)).select("h", "g", "n").toArrow()
    top = top.sort_by([("n", "descending"), ("h", "ascending")])
    top_h = top.column("h").to_numpy().astype(np.int64).view(np.uint64)
    top_n, top_g = top.column("n").to_numpy().astype(np.int64), top.column("g").to_numpy().astype(np.int64)
    singles = top_h[:SINGLES].copy()
    sub = F.pmod(F.shiftrightunsigned("h", 20), F.lit(SUBS)).cast("int")
    leaf_tokens, leaf_types = np.zeros(LEAVES), np.zeros(LEAVES)
    once, twice = np.zeros(CLASSES), np.zeros(CLASSES)
    rows = counts.groupBy("g", sub.alias("s")).agg(
        F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    )
    for g, sub_, n, v, n1, n2 in rows.collect():  # a row per leaf
        c = END_CLASS if g < 0 else SINGLES + g
        leaf = LEAVES - 1 if g < 0 else SINGLES + g * SUBS + sub_
        leaf_tokens[leaf], leaf_types[leaf] = n, v
        once[c] += n1
        twice[c] += n2
    tokens, types, end = int(leaf_tokens.sum()), int(leaf_types.sum()), int(leaf_tokens[LEAVES - 1])
    subs = subclass(singles)
    for i in range(len(singles)):
        c = SINGLES + top_g[i]
        leaf = SINGLES + top_g[i] * SUBS + subs[i]
        leaf_tokens[leaf] -= top_n[i]
        leaf_types[leaf] -= 1
        once[c] -= top_n[i] == 1
        twice[c] -= top_n[i] == 2
        leaf_tokens[i], leaf_types[i] = top_n[i], 1
    discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)
    discount[: len(singles)] = 0.0
    discount[END_CLASS] = 0.0
    class_tokens = np.bincount(class_of_leaf(), weights=leaf_tokens, minlength=CLASSES)
    return Vocabulary(tokens, types, singles, top_h, top_n, top_g, class_tokens, leaf_tokens, leaf_types, discount, end)


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    return p


@dataclass
class Weights:
    """Biases and weights of the classes, and of the subclasses (``sub_bias`` has a row per spelled class)."""

    buckets: int
    bias: np.ndarray
    table: np.ndarray
    sub_bias: np.ndarray
    sub_table: np.ndarray

    @classmethod
    def start(cls, vocabulary: Vocabulary) -> Weights:
        counts, n = vocabulary.class_tokens, vocabulary.buckets
        inner = vocabulary.leaf_tokens[SINGLES:-1].reshape(GROUPS, SUBS)
        return cls(
            n,
            np.log((counts + 0.1) / (counts.sum() + 0.1 * CLASSES)).astype(np.float32),
            np.zeros((FEATURES * n, CLASSES), dtype=np.float32),
            np.log((inner + 0.1) / (inner.sum(axis=1, keepdims=True) + 0.1 * SUBS)).astype(np.float32),
            np.zeros((len(SUB_FEATURES) * SUB_BUCKETS * n, SUBS), dtype=np.float32),
        )

    def logits(self, active: np.ndarray) -> np.ndarray:
        out = self.table[active[0]]
        for rows in active[1:]:
            out += self.table[rows]
        out += self.bias
        out -= out.max(axis=1, keepdims=True)
        return out

    def sub_logits(self, active: np.ndarray, classes: np.ndarray) -> np.ndarray:
        out = self.sub_table[active[0]]
        for rows in active[1:]:
            out += self.sub_table[rows]
        out += self.sub_bias[classes - SINGLES]
        out -= out.max(axis=1, keepdims=True)
        return out


def _tally(sums: np.ndarray, active: np.ndarray, p: np.ndarray) -> None:
    """Add the rows of ``p`` to the rows of ``sums`` that are active, feature by feature."""
    size = len(sums) // len(active)
    for k, row in enumerate(active):
        # a feature has 2**16 rows at most, and numbers of 16 bits are sorted in linear time
        order = np.argsort((row - k * size).astype(np.uint16), kind="stable")
        row = row[order]
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        sums[row[begin]] += np.add.reduceat(p[order], begin, axis=0)


def _gradient(vocabulary: Vocabulary, held: Broadcast, branches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: Weights = held.value
        index = Index(vocabulary.singles)
        sums = [(np.zeros(t.shape), np.zeros(t.shape)) for t in (weights.table, weights.sub_table)]
        any_ = False
        for batch in batches:
            buf, offsets = string_bytes(batch.column("text"))
            for a, b in row_windows(offsets):
                any_ = True
                tokens = tokenize(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                context, classes = contexts(tokens), vocabulary.classes(tokens, index)
                active = features(context, weights.buckets)
                inner = np.flatnonzero((classes >= SINGLES) & (classes != END_CLASS))
                subs, theirs = subclass(tokens.hashes[inner]), classes[inner]
                sub_active = sub_features([c[inner] for c in context], theirs, weights.buckets)
                for (observed, _), rows, targets in ((sums[0], active, classes), (sums[1], sub_active, subs)):
                    for row in rows:
                        cells, times = np.unique(row * observed.shape[1] + targets, return_counts=True)
                        observed.reshape(-1)[cells] += times
                for i in range(0, len(classes), STEP):
                    here = active[:, i : i + STEP]
                    _tally(sums[0][1], here, softmax(weights.logits(here)))
                for i in range(0, len(inner), STEP):
                    here = sub_active[:, i : i + STEP]
                    _tally(sums[1][1], here, softmax(weights.sub_logits(here, theirs[i : i + STEP])))
        if any_:
            branch = TaskContext.get().partitionId() % branches
            for number, (observed, expected) in enumerate(sums):
                for block, (o, e) in enumerate(zip(np.split(observed, BLOCKS), np.split(expected, BLOCKS), strict=True)):
                    yield _block_batch([(branch, number * BLOCKS + block, o.tobytes(), e.tobytes())])

    return run


_BLOCK = "branch int, block int, observed binary, expected binary"


def _block_batch(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays(columns, names=["branch", "block", "observed", "expected"])


def _sums_of(batches: Iterator[pa.RecordBatch], branches: bool) -> dict[tuple[int, int], list[np.ndarray]]:
    sums: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("branch", "block", "observed", "expected"))
        for branch, block, *parts in zip(*columns, strict=True):
            key = (branch if branches else 0, block)
            values = [np.frombuffer(p, dtype=np.float64) for p in parts]
            if key in sums:
                for old, new in zip(sums[key], values, strict=True):
                    old += new
            else:
                sums[key] = [v.copy() for v in values]
    return sums


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of a branch."""
    for (branch, block), (observed, expected) in _sums_of(batches, branches=True).items():
        yield _block_batch([(branch, block, observed.tobytes(), expected.tobytes())])


def _steps(held: Broadcast):
    """The steps of the weights of each block, from the sums over all branches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: Weights = held.value
        flat = np.exp(weights.bias.astype(np.float64))
        for (_, block), (observed, expected) in _sums_of(batches, branches=False).items():
            prior = SMOOTH * (flat if block < BLOCKS else np.full(SUBS, 1 / SUBS))
            observed, expected = observed.reshape(-1, len(prior)), expected.reshape(-1, len(prior))
            step = RATE * np.log((observed + prior) / (expected + prior))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([step.astype(np.float32).tobytes()], pa.binary())], names=["block", "step"]
            )

    return run


def train_weights(train: DataFrame, vocabulary: Vocabulary, part: Column) -> Weights:
    """ROUNDS distributed updates over the texts of ``train``; ``part`` deals them out, 0 .. ROUNDS - 1."""
    weights = Weights.start(vocabulary)
    context = train.sparkSession.sparkContext
    # a task ships sums of the size of the weights, so there are as many tasks as cores, or one for so many tokens
    tasks = max(context.defaultParallelism, -(-vocabulary.tokens // TOKENS_A_TASK))
    branches = max(1, int(tasks**0.5))
    for r in range(ROUNDS):
        held = context.broadcast(weights)
        steps = (
            train.where(part == r)
            .select("text")
            .coalesce(tasks)
            .mapInArrow(trimmed(_gradient(vocabulary, held, branches)), _BLOCK)
            # a tree: the tasks' sums meet in branches first, the branches' then in the blocks
            .repartition(branches * 4, "branch", F.col("block") % 4)
            .mapInArrow(_add_up, _BLOCK)
            .repartition(2 * BLOCKS, "block")
            .mapInArrow(_steps(held), "block int, step binary")
            .collect()  # the size of the weights
        )
        for row in steps:
            flat = (weights.table if row["block"] < BLOCKS else weights.sub_table).reshape(BLOCKS, -1)
            flat[row["block"] % BLOCKS] += np.frombuffer(row["step"], dtype=np.float32)
        held.unpersist()
    return weights


_SCORES = "doc_id long, text_key long, h long, leaf int, n long, rows long, n_tokens long, n_known long, base double, score double"


def _score(known_to_all: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = known_to_all.value
        index = Index(vocabulary.top)
        classes_of = SINGLES + vocabulary.top_groups
        classes_of[: len(vocabulary.singles)] = np.arange(len(vocabulary.singles))
        # an entry more each: words that are not in the table, which are settled by the join
        within = np.append(vocabulary.known(vocabulary.top_counts, leaves(classes_of, subclass(vocabulary.top))), 0.0)
        base = np.append(vocabulary.base(vocabulary.top_counts), 0.0)
        classes_of = np.append(classes_of, 0)
        end_base = float(vocabulary.base(np.array([vocabulary.end_count]))[0])
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy() for c in ("doc_id", "text_key"))
            buf, offsets = string_bytes(batch.column("text"))
            for a, b in row_windows(offsets):
                tokens = tokenize(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                context = contexts(tokens)
                active = features(context, weights.buckets)
                ends = tokens.groups < 0
                found = index.find(tokens.hashes)
                found[ends] = -1
                classes = np.where(found >= 0, classes_of[found], SINGLES + tokens.groups.astype(np.int64))
                classes[ends] = END_CLASS
                score = np.empty(len(found))
                for i in range(0, len(found), STEP):
                    logits = weights.logits(active[:, i : i + STEP])
                    own = logits[np.arange(len(logits)), classes[i : i + STEP]]
                    score[i : i + STEP] = own - np.log(np.exp(logits).sum(axis=1))
                inner = np.flatnonzero((classes >= SINGLES) & (classes != END_CLASS))
                theirs, subs = classes[inner], subclass(tokens.hashes[inner])
                sub_active = sub_features([c[inner] for c in context], theirs, weights.buckets)
                for i in range(0, len(inner), STEP):
                    logits = weights.sub_logits(sub_active[:, i : i + STEP], theirs[i : i + STEP])
                    own = logits[np.arange(len(logits)), subs[i : i + STEP]]
                    score[inner[i : i + STEP]] += own - np.log(np.exp(logits).sum(axis=1))
                score /= np.log(10)
                score += within[found]
                bases = base[found]
                bases[ends] = end_base
                known = found >= 0
                if vocabulary.end_count:
                    known |= ends
                first = tokens.first
                rare = np.flatnonzero((found < 0) & ~ends)
                doc = np.searchsorted(first, rare, side="right") - 1
                order = np.lexsort((tokens.hashes[rare], doc))
                doc, rare = doc[order], rare[order]
                h = tokens.hashes[rare]
                begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
                counts = np.diff(np.append(begin, len(h)))
                n, m = b - a, len(begin)
                zero = lambda k, t=np.int64: np.zeros(k, dtype=t)
                columns = [
                    np.concatenate([ids[a:b], ids[a:b][doc[begin]]]),
                    np.concatenate([keys[a:b], keys[a:b][doc[begin]]]),
                    # sums of texts join with nothing; equal texts are dealt by their ids
                    np.concatenate([keys[a:b] ^ (ids[a:b] * 0x9E3779B97F4A7C1 + 1), h[begin].view(np.int64)]),
                    np.concatenate([np.full(n, -1), leaves(classes[rare[begin]], subclass(h[begin]))]).astype(np.int32),
                    np.concatenate([zero(n), counts]),
                    np.concatenate([np.ones(n, dtype=np.int64), zero(m)]),
                    np.concatenate([np.diff(np.append(first, len(found))), zero(m)]),
                    np.concatenate([np.add.reduceat(known.astype(np.int64), first), zero(m)]),
                    np.concatenate([np.add.reduceat(bases, first), zero(m, np.float64)]),
                    np.concatenate([np.add.reduceat(score, first), zero(m, np.float64)]),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns],
                    names=["doc_id", "text_key", "h", "leaf", "n", "rows", "n_tokens", "n_known", "base", "score"],
                )

    return run


def lm_score(docs: DataFrame, held_out: Column | None = None, part: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text); learns from the rows that ``held_out`` (a boolean) leaves."""
    remainder = id_remainder("doc_id", FOLDS)
    held_out = held_out if held_out is not None else remainder == HELD
    part = part if part is not None else id_remainder("doc_id", FOLDS * ROUNDS).cast("long") % ROUNDS
    rows = expect_columns(docs, "doc_id", "text")
    train = rows.where(~held_out).withColumn("part", part)
    counts = stored(count_words(train))
    vocabulary = summarise(counts)
    weights = train_weights(train, vocabulary, F.col("part"))
    known_to_all = docs.sparkSession.sparkContext.broadcast((vocabulary, weights))
    emitted = rows.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        "text",
    ).mapInArrow(trimmed(_score(known_to_all)), _SCORES)
    rarer = counts.where("g >= 0").select("h", F.col("n").alias("c"))
    shares = docs.sparkSession.createDataFrame(
        [
            (leaf, float(d), float(max(n, 1.0)), float(u))
            for leaf, (d, n, u) in enumerate(
                zip(vocabulary.discount[class_of_leaf()], vocabulary.leaf_tokens, vocabulary.unknown(), strict=True)
            )
        ],
        "leaf int, discount double, seen double, unknown double",
    )
    is_rare = F.col("n") > 0
    c = F.coalesce("c", F.lit(0)).cast("double")
    total = float(vocabulary.tokens + vocabulary.types + 1)
    inside = F.when(
        F.col("c").isNotNull(), F.log10(F.greatest(c - F.col("discount"), F.lit(1e-3)) / F.col("seen"))
    ).otherwise(F.col("unknown"))
    settled = emitted.join(F.broadcast(shares), "leaf", "left").join(rarer, "h", "left").select(
        "doc_id",
        "text_key",
        "rows",
        "n_tokens",
        F.when(is_rare, F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).otherwise(F.col("n_known")).alias("n_known"),
        F.when(is_rare, F.col("n") * F.log10((c + 1) / total)).otherwise(F.col("base")).alias("base"),
        F.when(is_rare, F.col("n") * inside).otherwise(F.col("score")).alias("score"),
    )
    sums = settled.groupBy("doc_id", "text_key").agg(*[F.sum(x).alias(x) for x in ("rows", "n_tokens", "n_known", "base", "score")])
    each = lambda x: (F.col(x) / F.col("rows"))
    return (
        sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
        .withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
        .select(
            "doc_id",
            held_out.alias("held_out"),
            each("n_tokens").cast("long").alias("n_tokens"),
            each("n_known").cast("long").alias("n_known"),
            F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
            each("base").alias("base_score"),
            each("score").alias("score"),
        )
    )
