"""Shared pieces: durable cuts of lineage, row identity and byte-level text kernels."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: ASCII white space, as in the class [\x20\x09-\x0D].
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
#: A-Z to a-z, everything else unchanged.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True

#: Bytes of text handled at once inside a batch.
WINDOW = 1 << 21


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: what the session names, else (local runs only) a fresh one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder; survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints; it is removed when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: What a task that writes such a table holds.
ROW_GROUP = 16 << 20


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: smaller than a checkpoint, and read by column."""
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.parquet(path)


#: Rows of a batch that goes to a Python worker.  Texts are long, so Spark's default of 10,000 is too many to hold several times.
BATCH_ROWS = 2000
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Let the session send BATCH_ROWS rows to Python at once, unless it is set to fewer already."""
    if int(spark.conf.get(_RECORDS)) > BATCH_ROWS:
        spark.conf.set(_RECORDS, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus).cast("int")


def string_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, starting at 0) of a string column; null counts as empty."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None or not len(array) or off[-1] == off[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(array) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def row_windows(offsets: np.ndarray, size: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``size`` bytes (one row at least)."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, end
        row = end


def token_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of white-space separated words and the number of the first word of each row.

    ``first`` has one entry more than there are rows: row r has words first[r]:first[r+1].
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[buf]
    cut = offsets[(offsets > 0) & (offsets < len(buf))]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    before[cut] = False
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    after[cut - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _splitmix(n: int) -> np.ndarray:
    z = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: A pseudo-random 64-bit value for each byte, A-Z as a-z.
_BYTE = _splitmix(256)
_BYTE_LOWER = _BYTE[np.frombuffer(LOWER_BYTES, dtype=np.uint8)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, WINDOW + 4096)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table_ = np.full(size, base & _MASK, dtype=np.uint64)
            table_[0] = 1
            out.append(np.multiply.accumulate(table_))
        _powers = (out[0], out[1])
    return _powers


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes (uint64) of the lower-cased words buf[start:end].

    A polynomial over pseudo-random byte values modulo 2**64, taken from prefix sums, then mixed;
    equal words have equal hashes wherever they stand.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + WINDOW, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        power, inverse = _power_tables(b - a + 1)
        sums = np.empty(b - a + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE_LOWER[buf[a:b]] * power[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix64((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out


def give_back() -> None:
    """Return memory that this process has freed to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
    if trim is not None:
        trim(0)


def trimmed(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` whose worker gives back at the end what it does not hold any more.

    Workers stay for later tasks; what their allocators keep would count against the executor meanwhile."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def expect_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns go on, so that others, whatever their names, cannot clash."""
    return df.select(*[df[n] for n in names])


#: At most so many keys hold more than one in HOT_SHARE of all rows.
HOT_SHARE = 1000


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """Equi-join (inner or left) of ``rows`` with ``groups``, which has one row for a key and the number of rows with it.

    Keys that hold more than one in HOT_SHARE of the grouped rows are HOT_SHARE at most, so they are sent to the
    rows; the rows of all others move to their key.  Both tables are read twice and should be stored ones.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    edge = max(total // HOT_SHARE, HOT_SHARE)
    payload = [c for c in groups.columns if c not in keys]
    hot = F.broadcast(groups.where(F.col(size) > edge).select(*keys, *payload))
    cold = groups.where(F.col(size) <= edge).select(*keys, *payload)
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how))


#: Bits of a key filter: of the whole at most, and for each key.
FILTER_BITS, BITS_A_KEY = 1 << 27, 16
PROBES = 4


def _filter_bits(key: Column, size: int) -> list[Column]:
    """The PROBES bits of a filter of ``size`` bits that a key (long) stands for."""
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(size).cast("long")) for i in range(PROBES)]


def key_filter(keys: DataFrame, size: int) -> DataFrame:
    """A Bloom filter of the one column of ``keys`` (long): one row, ``words`` with ``size`` bits.

    Bits are set by partial aggregates and meet word by word; what is collected has FILTER_BITS bits at most."""
    bit = keys.select(F.explode(F.array(*_filter_bits(F.col(keys.columns[0]), size))).alias("bit"))
    found = (
        bit.select(F.shiftright("bit", 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
        .groupBy("at")
        .agg(F.bit_or("mask").alias("word"))
        .toArrow()
    )
    words = np.zeros(size // 64, dtype=np.int64)
    words[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return keys.sparkSession.createDataFrame(pa.table({"words": pa.ListArray.from_arrays([0, len(words)], pa.array(words))}))


def marked_rows(rows: DataFrame, marked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose ``key`` may be among the keys ``marked`` (one column, long), and those whose key
    certainly is not.

    What is to be done with few rows is done without moving the others.  Where the filter ends, at FILTER_BITS, ever more
    rows are taken for marked, which costs time only.
    """
    size = min(FILTER_BITS, max(1 << 12, 1 << int(marked.count() * BITS_A_KEY).bit_length()))
    words = key_filter(marked, size).scalar()

    def is_set(bit: Column) -> Column:
        word = F.get(words, F.shiftright(bit, 6).cast("int"))
        return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63).cast("long")).cast("int"))) != 0

    may = F.lit(True)
    for bit in _filter_bits(F.col(f"`{key}`"), size):
        may = may & is_set(bit)
    return rows.where(may), rows.where(~may)
