"""Small helpers that several operators of this package share."""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task looks at together in numpy; a longer text is looked at alone.
PIECE_BYTES = 1 << 21
#: Rows of a batch that a worker looks at, and sends on, together.
TAKEN_ROWS = 1024
#: Odd, so that its powers have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def give_back() -> None:
    """Memory that is free in this process goes back to the system.

    Allocators keep it for later, but workers live on from task to task and stage to stage: what each held at its most
    would add up over all of an executor's workers, also those that are idle.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # only glibc has it
        pass


def sparing(run: Callable) -> Callable:
    """``run``, a function of Arrow batches, on a few rows of a batch at a time, with memory given back after each batch.

    It gets the same rows in the same order, but none of empty batches.
    """

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TAKEN_ROWS):
                yield batch.slice(first, TAKEN_ROWS)
            del batch
            give_back()

    def spared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(few(batches))
        give_back()

    return spared


def text_slices(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of runs of rows with about ``most`` bytes each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    # a column is some ten megabytes in each worker, so it is read where it lies
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int32 if pa.types.is_string(column.type) else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        first = last


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """Words of a run of texts: byte spans, text index and a 64-bit content hash, all by array operations.

    ``keep`` has a flag per byte value, true for bytes of words; ``fold`` maps byte values first.
    """

    def __init__(self, offsets: np.ndarray, data: np.ndarray, keep: np.ndarray, fold: np.ndarray):
        self.data = data = fold[data]
        inside = keep[data]
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        filled = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[filled] = False
        after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets[:-1])
        self.count = np.searchsorted(self.start, offsets[1:]) - self.first
        self.text = np.repeat(np.arange(len(offsets) - 1), self.count)
        self._sums: np.ndarray | None = None

    def hashes(self, upto: np.ndarray | None = None) -> np.ndarray:
        """Content hash of each word, or of its bytes before ``upto``."""
        power, inverse = _powers(len(self.data))
        if self._sums is None:
            # in place: eight bytes a byte of text for every step would be most of a worker's memory
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            each = self._sums[1:]
            np.add(self.data, np.uint64(1), out=each)
            each *= power
            np.cumsum(each, out=each)
        end = self.end if upto is None else upto
        return mixed((self._sums[end] - self._sums[self.start]) * inverse[self.start])


class _Kept(list):
    """A list that reaches the workers empty: functions of this package go there by value, with the globals they use."""

    def __reduce__(self):
        return _Kept, ()


#: Powers that are kept at least.
LEAST_POWERS = 1 << 18
_kept_powers: list[np.ndarray] = _Kept()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > PIECE_BYTES:
        return _series(BASE, n), _series(pow(BASE, -1, 1 << 64), n + 1)
    if not _kept_powers or len(_kept_powers[0]) < n:
        # no more than the operator's slices ask for: they are sixteen bytes a byte of text
        most = max(LEAST_POWERS, 1 << (n - 1).bit_length())
        _kept_powers[:] = _series(BASE, most), _series(pow(BASE, -1, 1 << 64), most + 1)
    return _kept_powers[0][:n], _kept_powers[1][: n + 1]


def _series(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def lower_ascii() -> np.ndarray:
    """Byte map that lower-cases A-Z."""
    fold = np.arange(256, dtype=np.uint8)
    fold[ord("A") : ord("Z") + 1] += 32
    return fold


def not_space() -> np.ndarray:
    """True for bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    keep = np.ones(256, bool)
    keep[[0x20, *range(0x09, 0x0E)]] = False
    return keep


def alphanumeric() -> np.ndarray:
    """True for bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of folded text."""
    keep = np.ones(256, bool)
    for a, b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
        keep[a : b + 1] = False
    return keep


def content_key(docs: DataFrame, text: str = "text") -> Column:
    """With the id it tells rows apart: rows equal in both are repeats and share every result."""
    return F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("_th")


def id_part(parts: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id has part 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts)), F.lit(0)).cast("int")


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front of those that ``df`` has already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def hex_of(c: Column) -> Column:
    """A long as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")
