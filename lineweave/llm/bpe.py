"""Byte-level BPE encoding and decoding in length-bucketed padded matrices.

A text is cut by the tokenizer's pattern.  The distinct pieces of a batch that a worker has not
met before are put into padded matrices of token ids by length; every round merges, in each row,
the leftmost pair of lowest rank (pairs are looked up in an open hash table) and closes the gap;
rows without a pair leave.  Pieces longer than LONG bytes take a heap over a linked list
instead, whose work grows as n log n.  Decoding gathers the bytes of all ids at once.

Defined results: a null text counts as empty and gives no ids; strings of special tokens are
ordinary text; null ids keep their rows; very long texts are encoded whole; rows may repeat; columns
besides doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import expect_columns, trimmed

#: Longest piece (bytes) that goes into a matrix.
LONG = 512
#: Cells of a matrix.
CELLS = 1 << 18
#: Pieces a worker remembers.
REMEMBERED = 200_000
#: Characters that are cut into pieces at once.
WINDOW = 1 << 19
PAD = -1
NONE = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks from a file with a base64 string and a number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}


@dataclass
class Vocabulary:
    """Ranks of byte strings, the pair table derived from them, and the bytes of all ids."""

    ranks: dict[bytes, int]
    pair_keys: np.ndarray = field(init=False)
    pair_ids: np.ndarray = field(init=False)
    shift: int = field(init=False)
    probes: int = field(init=False)
    single: np.ndarray = field(init=False)
    offsets: np.ndarray = field(init=False)
    blob: np.ndarray = field(init=False)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        return cls(read_ranks(path))

    def __post_init__(self) -> None:
        ranks = self.ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        bits = max(4, (len(pairs) * 4).bit_length())
        self.shift = 64 - bits
        keys = np.full(1 << bits, -1, dtype=np.int64)
        ids = np.full(1 << bits, NONE, dtype=np.int32)
        left_k = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        left_v = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        slot = self._slot(left_k)
        self.probes = 0
        while len(left_k):  # each pass seats one key in every free slot that is asked for
            self.probes += 1
            free = np.flatnonzero(keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            seated = free[first]
            keys[slot[seated]], ids[slot[seated]] = left_k[seated], left_v[seated]
            rest = np.ones(len(left_k), dtype=bool)
            rest[seated] = False
            left_k, left_v, slot = left_k[rest], left_v[rest], (slot[rest] + 1) & ((1 << bits) - 1)
        self.pair_keys, self.pair_ids = keys, ids
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        tokens = [b""] * len(lengths)
        for token, rank in ranks.items():
            lengths[rank], tokens[rank] = len(token), token
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> np.uint64(self.shift)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each merged pair, NONE where there is no such pair."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        found = self.pair_keys[slot]
        out = np.where(found == keys, self.pair_ids[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        mask = len(self.pair_keys) - 1
        at = slot[open_]
        while len(open_):
            at = (at + 1) & mask
            found = self.pair_keys[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.pair_ids[at[hit]]
            go = ~hit & (found != -1)
            open_, at = open_[go], at[go]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        begin, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        out = np.cumsum(size)
        total = int(out[-1]) if len(out) else 0
        return self.blob[np.repeat(begin - (out - size), size) + np.arange(total)].tobytes()


def merge_matrix(vocabulary: Vocabulary, pieces: list[bytes], width: int) -> list[np.ndarray]:
    """Ids of pieces of at most ``width`` bytes."""
    n = len(pieces)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
    ids = vocabulary.single[raw]
    ids[np.arange(width) >= lengths[:, None]] = PAD
    done: list[np.ndarray | None] = [None] * n
    row_of, left = np.arange(n), lengths.copy()
    ranks = np.full((n, max(width - 1, 1)), NONE, dtype=np.int32)
    if width > 1:
        r, c = np.nonzero(ids[:, 1:] != PAD)
        ranks[r, c] = vocabulary.pair_ranks(ids[r, c], ids[r, c + 1])
    while len(row_of):
        at = ranks.argmin(axis=1)
        rows = np.arange(len(row_of))
        best = ranks[rows, at]
        over = best == NONE
        if over.any():
            for i in np.flatnonzero(over):
                done[row_of[i]] = ids[i, : left[i]].astype("<u4")
            keep = ~over
            ids, ranks, row_of, left, at, best = ids[keep], ranks[keep], row_of[keep], left[keep], at[keep], best[keep]
            if not len(row_of):
                break
            most = int(left.max())
            ids, ranks, rows = ids[:, :most].copy(), ranks[:, : most - 1].copy(), rows[: len(row_of)]
        cols = np.arange(ids.shape[1] - 1)
        ids[rows, at] = best
        shift = cols[None, :] > at[:, None]
        ids[:, :-1] = np.where(shift, ids[:, 1:], ids[:, :-1])
        ids[:, -1] = PAD
        if ranks.shape[1] > 1:
            shift = cols[None, :-1] >= at[:, None]
            ranks[:, :-1] = np.where(shift, ranks[:, 1:], ranks[:, :-1])
        ranks[:, -1] = NONE
        left -= 1
        # only the two pairs that touch the new token change
        has = at < left - 1
        r, c = rows[has], at[has]
        ranks[r, c] = vocabulary.pair_ranks(ids[r, c], ids[r, c + 1])
        tail = ~has & (at < ranks.shape[1])
        ranks[rows[tail], at[tail]] = NONE
        has = at > 0
        r, c = rows[has], at[has] - 1
        ranks[r, c] = vocabulary.pair_ranks(ids[r, c], ids[r, c + 1])
    return done  # type: ignore[return-value]


def merge_long(vocabulary: Vocabulary, piece: bytes) -> np.ndarray:
    """Ids of one piece of any length: a heap of (rank, place) over a linked list."""
    n = len(piece)
    ids = vocabulary.single[np.frombuffer(piece, dtype=np.uint8)].tolist()
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    known = vocabulary.pair_ranks(np.array(ids[:-1], dtype=np.int32), np.array(ids[1:], dtype=np.int32)).tolist()
    none = int(NONE)
    current = [*known, none]
    heap = [(r, i) for i, r in enumerate(known) if r != none]
    heapq.heapify(heap)

    def rank(i: int) -> int:
        if i < 0 or after[i] < 0:
            return none
        return int(vocabulary.pair_ranks(np.array([ids[i]]), np.array([ids[after[i]]]))[0])

    while heap:
        r, i = heapq.heappop(heap)
        if current[i] != r:
            continue
        gone = after[i]
        ids[i], after[i], current[gone] = r, after[gone], none
        if after[i] >= 0:
            before[after[i]] = i
        for j in (before[i], i):
            if j >= 0:
                current[j] = rank(j)
                if current[j] != none:
                    heapq.heappush(heap, (current[j], j))
    out, i = [], 0
    while i >= 0:
        out.append(ids[i])
        i = after[i]
    return np.array(out, dtype="<u4")


class Encoder:
    """Encodes texts; remembers the pieces it has met."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary = vocabulary
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.vocabulary.ranks.get(raw)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.known[piece] = merge_long(self.vocabulary, raw).tobytes()
            else:
                n = len(raw)
                by_width.setdefault(-(-n // 4) * 4 if n <= 32 else 1 << (n - 1).bit_length(), []).append((piece, raw))
        for width, found in by_width.items():
            step = max(1, CELLS // width)
            for i in range(0, len(found), step):
                part = found[i : i + step]
                for (piece, _), ids in zip(part, merge_matrix(self.vocabulary, [r for _, r in part], width), strict=True):
                    self.known[piece] = ids.tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        cut = [self.find(t) for t in texts]
        unseen: set[str] = set()
        for pieces in cut:
            unseen.update(pieces)
        fresh = unseen - self.known.keys()
        self.learn(fresh)
        get = self.known.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in cut]
        if len(self.known) > REMEMBERED:  # the frequent ones came early; forget those of this call
            for piece in fresh:
                del self.known[piece]
        return out

    def stream(self, texts: pa.Array) -> Iterator[bytes]:
        """``encode_all`` over a column, about WINDOW characters at a time; null counts as empty."""
        held: list[str] = []
        size = 0
        for value in texts:
            text = value.as_py() or ""
            if held and size + len(text) > WINDOW:
                yield from self.encode_all(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        yield from self.encode_all(held)


_encoders: dict[tuple[str, str], Encoder] = {}


def shared_encoder(path: str, pattern: str) -> Encoder:
    """One per worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(Vocabulary.load(path), pattern)
    return _encoders[path, pattern]


def bpe_encode(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    ``path`` is a file of ranks that every machine can read, ``pattern`` the regular expression that cuts texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path, pattern)
        for batch in batches:
            encoded = list(encoder.stream(batch.column("text")))
            arrays = [np.frombuffer(e, dtype="<u4").astype(np.int64) for e in encoded] if ids else None
            columns = [
                batch.column("doc_id"),
                pa.array([len(e) // 4 for e in encoded], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in encoded], pa.string()),
                pa.array(
                    [
                        hashlib.sha256(encoder.vocabulary.decode(np.frombuffer(e, dtype="<u4").astype(np.int64))).hexdigest()
                        for e in encoded
                    ],
                    pa.string(),
                ),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if arrays is not None:
                columns.append(pa.array(arrays, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = expect_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(trimmed(run), schema + ", ids array<long>" * ids)
