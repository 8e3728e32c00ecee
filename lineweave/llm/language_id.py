"""Language identification by rank-order profiles of character n-grams.

A profile is a language's PROFILE most frequent n-grams (1 to ORDER letters, words padded with
a space, n-grams never cross a word) in rank order.  A text's own list of most frequent n-grams
is compared with each profile: the out-of-place distance sums how far each of its n-grams is
from its rank there, PROFILE where it is missing.  The least distance wins, ties go to the
language that sorts first.  ``distance`` is the least distance as a share of the largest possible one, by which
texts in none of the learned languages can be told (``is_foreign``).

The score is the margin over the runner-up, (second - best) / second, from 0 to 1; 1 if only one
language is known.  A text that is null or has no letters is ``und`` with score 0, and so is any text
if nothing was learned.  Very long texts are counted in pieces, with the same n-grams.  Rows with a null
language teach nothing; a null id counts as the empty
text when folds are dealt; rows may repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import expect_columns, id_remainder, mix64, trimmed

ORDER = 3
PROFILE = 300
UNKNOWN = "und"
#: A text with FEW distinct n-grams or more that is further away than FAR is in none of the learned languages.
FAR, FEW = 0.7, 100
#: Characters handled at once.
CHARS = 1 << 18
#: N-grams of one language that a task holds before it passes them on.
HELD = 1 << 20

_SPACE = 32
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For every code point its lower-case letter, or a space."""
    global _letters
    if _letters is None:
        out = np.full(0x110000, _SPACE, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                out[i] = ord(c.lower()[0])
        _letters = out
    return _letters


def _normalise(text: str, begins: bool = True, ends: bool = True) -> np.ndarray:
    """Letters, each run of anything else as one space, with a space at both ends (unless the text goes on there);
    empty without letters."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = letter_table()[raw]
    pad = [np.uint32(_SPACE)]
    letters = np.concatenate([pad if begins else [], letters, pad if ends else []]).astype(np.uint32)
    solid = letters != _SPACE
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    keep[:1] |= begins
    letters = letters[keep]
    # a leading run of spaces leaves one space before the first word
    return letters if len(letters) > 1 else letters[:0]


def _keys(letters: np.ndarray, seen: int = 0) -> np.ndarray:
    """40-bit keys of all n-grams but those within the first ``seen`` letters."""
    c = letters.astype(np.uint64)
    out = []
    for n in range(1, ORDER + 1):
        if len(c) < n:
            break
        m = len(c) - n + 1
        key = np.full(m, n, dtype=np.uint64) << np.uint64(61)
        for k in range(n):
            key |= c[k : k + m] << np.uint64(20 * k)
        inner = np.ones(m, dtype=bool)
        for k in range(n) if n == 1 else range(1, n - 1):
            inner &= letters[k : k + m] != _SPACE
        if n == 2:
            inner &= (letters[:m] != _SPACE) | (letters[1:] != _SPACE)
        inner[: max(0, seen - n + 1)] = False
        out.append(key[inner])
    return mix64(np.concatenate(out)) >> np.uint64(24) if out else np.zeros(0, dtype=np.uint64)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(ordered):
        return ordered, np.zeros(0, dtype=np.int64)
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[begin], np.diff(np.append(begin, len(ordered)))


def _slices(text: str) -> Iterator[tuple[str, bool, bool]]:
    """Pieces of bounded size, and whether each begins and ends a word there.

    A cut falls behind something that is no letter; where there is none, the next piece repeats the last letters that
    n-grams across the cut need."""
    at, begins = 0, True
    while at < len(text):
        end, ends = min(len(text), at + CHARS), True
        if end < len(text):
            raw = np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            gaps = np.flatnonzero(letter_table()[raw] == _SPACE)
            ends = len(gaps) > 0
            end = at + int(gaps[-1]) + 1 if ends else end
        yield text[at:end], begins, ends
        at, begins = end if ends else end - (ORDER - 1), ends


def count_ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, count), sorted by row and key, of all n-grams of the texts."""
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            mixed, counts = _runs(np.sort(np.concatenate(held)))
            done.append((mixed >> np.uint64(40), mixed & np.uint64((1 << 40) - 1), counts))
        held, size = [], 0

    for row, text in enumerate(texts):
        for piece, begins, ends in _slices(text):
            keys = _keys(_normalise(piece, begins, ends), 0 if begins else ORDER - 1)
            held.append(keys | np.uint64(row << 40))
            size += len(piece)
            if size >= CHARS:
                flush()
    flush()
    if not done:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty.astype(np.uint64), empty
    rows, keys, counts = (np.concatenate(x) for x in zip(*done, strict=True))
    mixed = rows << np.uint64(40) | keys
    if len(done) > 1 and (mixed[1:] <= mixed[:-1]).any():  # a text that was cut
        order = np.argsort(mixed, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], np.diff(mixed[order]) != 0]))
        counts = np.add.reduceat(counts[order], begin)
        mixed = mixed[order][begin]
    return (mixed >> np.uint64(40)).astype(np.int64), mixed & np.uint64((1 << 40) - 1), counts


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of n-grams by language."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    sizes: dict[str, int] = {}

    def out(lang: str) -> pa.RecordBatch:
        parts = held.pop(lang)
        sizes.pop(lang)
        keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)],
            names=["lang", "key", "n"],
        )

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            mine = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            i = 0
            while i < len(mine):
                j, size = i, 0
                while j < len(mine) and (j == i or size + len(mine[j]) <= CHARS):
                    size += len(mine[j])
                    j += 1
                joined = " ".join(mine[i:j])
                _, keys, counts = count_ngrams([joined])
                held.setdefault(lang, []).append((keys, counts))
                sizes[lang] = sizes.get(lang, 0) + len(keys)
                if sizes[lang] > HELD:
                    yield out(lang)
                i = j
    for lang in list(held):
        yield out(lang)


def learn_profiles(docs: DataFrame) -> dict[str, list[int]]:
    """The PROFILE most frequent n-gram keys of each language of ``docs`` (text, lang), in rank order."""
    taught = (
        expect_columns(docs, "text", "lang")
        .where("lang IS NOT NULL AND text IS NOT NULL")
        .mapInArrow(trimmed(_teach), "lang string, key long, n long")
        .groupBy("lang", "key")
        .agg(F.sum("n").alias("n"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    top = taught.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "rank").select("lang", "key").collect():
        profiles.setdefault(row[0], []).append(row[1])
    return profiles


class Classifier:
    def __init__(self, profiles: dict[str, list[int]]) -> None:
        self.langs = sorted(profiles)
        self.keys = np.unique(np.array([k for p in profiles.values() for k in p], dtype=np.uint64))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, dtype=np.int64)
        for j, lang in enumerate(self.langs):
            for rank, key in enumerate(profiles[lang]):
                self.ranks[np.searchsorted(self.keys, np.uint64(key)), j] = rank

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores, distances (NaN for ``und``) and numbers of distinct n-grams that were compared."""
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        far, sizes = np.full(len(texts), np.nan), np.zeros(len(texts), dtype=np.int64)
        rows, keys, counts = count_ngrams(texts)
        if not len(rows) or not self.langs:
            return langs, scores, far, sizes
        order = np.lexsort((keys, -counts, rows))
        rows, keys = rows[order], keys[order]
        begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        rank = np.arange(len(rows)) - np.repeat(begin, np.diff(np.append(begin, len(rows))))
        top = rank < PROFILE
        rows, keys, rank = rows[top], keys[top], rank[top]
        at = np.searchsorted(self.keys, keys)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != keys)] = len(self.keys)
        theirs = self.ranks[at]
        apart = np.where(theirs < 0, PROFILE, np.abs(theirs - rank[:, None]))
        begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        distance = np.add.reduceat(apart, begin, axis=0)
        best = distance.argmin(axis=1)
        if len(self.langs) > 1:
            two = np.partition(distance, 1, axis=1)[:, :2]
            margin = (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1)
        else:
            margin = np.ones(len(distance))
        for row, j, score in zip(rows[begin], best, margin, strict=True):
            langs[row], scores[row] = self.langs[j], score
        sizes[rows[begin]] = np.diff(np.append(begin, len(rows)))
        far[rows[begin]] = distance.min(axis=1) / (PROFILE * sizes[rows[begin]])
        return langs, scores, far, sizes


def is_foreign(lang: Column, distance: Column, ngrams: Column) -> Column:
    """Whether a text is in none of the learned languages, as far as can be told."""
    return (lang == UNKNOWN) | F.coalesce((distance > FAR) & (ngrams >= FEW), F.lit(False))


#: Columns that ``predict`` adds.
PREDICTED = ("lang_pred", "score", "distance", "ngrams")


def predict(docs: DataFrame, profiles: dict[str, list[int]], into: tuple[str, ...] = PREDICTED) -> DataFrame:
    """``docs`` with the columns ``into`` (language, score, distance, number of n-grams); only the column ``text`` is
    looked at."""
    docs = docs.drop(*into)
    names = docs.columns
    types = [StringType(), DoubleType(), DoubleType(), LongType()]
    schema = StructType([*docs.schema.fields, *(StructField(n, t) for n, t in zip(into, types, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(profiles)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            langs: list[str] = []
            numbers: list[tuple[np.ndarray, ...]] = [(np.zeros(0), np.zeros(0), np.zeros(0, dtype=np.int64))]
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= CHARS):
                    size += len(texts[j])
                    j += 1
                found, *values = classify(texts[i:j])
                langs += found
                numbers.append(tuple(values))
                i = j
            scores, far, sizes = (np.concatenate(x) for x in zip(*numbers, strict=True))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(far, from_pandas=True), pa.array(sizes)],
                names=[*names, *into],
            )

    return docs.mapInArrow(trimmed(run), schema)


def held_out(folds: int = 5, fold: int = 0) -> Column:
    return id_remainder("doc_id", folds) == fold


def language_id(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): held_out, lang_pred, score; learns from the other folds."""
    rows = expect_columns(docs, "doc_id", "text", "lang")
    profiles = learn_profiles(rows.where(~held_out()))
    return predict(rows.select("doc_id", "text"), profiles).select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), *PREDICTED
    )
