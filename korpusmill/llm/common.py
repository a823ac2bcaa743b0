"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusmill.functions.session import plain_unions


def fresh(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name.lower() in taken:
        name = f"_{base}_{uuid.uuid4().hex[:6]}"
    return name


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder of ``spark.checkpoint.dir``.

    Where that is unset, a local master (a test, a notebook) gets a temporary folder; a cluster, whose executors would each
    write to a disk of their own, gets an error.
    """
    plain_unions(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint()


def text_size(text: Column) -> Column:
    """UTF-8 bytes; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text at the most; one longer text stands alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        i = 0
        while i < batch.num_rows:
            floor = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, floor + most, "right")))
            yield batch.slice(i, j - i)
            i = j


#: What ``[^\x20\x09-\x0D]+`` leaves out.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of equal, non-zero ``kind`` inside a row."""
    n = len(kind)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    change = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[offsets] = True
    at = np.flatnonzero(change)
    start, end = at[:-1], at[1:]
    keep = kind[start] != 0
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word ``[^\\x20\\x09-\\x0D]+``."""
    return runs((~SPACE[data]).view(np.uint8), offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of lower-cased words with single spaces between; start and end of each shingle in it; its row."""
    start, end, row = words(data, offsets)
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    keep = ~SPACE[data]
    gap = end[end < len(data)]
    gap = gap[SPACE[data[gap]]]
    keep[gap] = True
    lower[gap] = 32
    moved = np.concatenate([[0], np.cumsum(keep)])
    a, b = moved[start], moved[start] + (end - start)
    n = len(start)
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    last = np.append(first[1:], n) - 1  # last word of each row
    until = np.minimum(np.arange(n) + width - 1, last[row]) if n else np.zeros(0, np.int64)
    ok = (np.arange(n) + width - 1 <= until) | (np.arange(n) == first[row]) if n else np.zeros(0, bool)
    return lower[keep].tobytes(), a[ok], b[until[ok]], row[ok]


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle, repeats included, in order of rows; its row."""
    buf, start, end, row = shingles(data, offsets, width)
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(buf[a:b], 42) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start)), row


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _Q)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class SpanHash:
    """64-bit polynomial hashes of any spans of one byte array, each in constant time; another hash for each ``salt``."""

    def __init__(self, data: np.ndarray, salt: int = 0):
        n = len(data)
        up, self.down = _power(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        table = scramble(_BYTE + np.uint64(salt)) if salt else _BYTE
        np.cumsum(table[data] * up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return scramble((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))
