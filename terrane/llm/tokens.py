"""Words of whole Arrow text columns, found with numpy on the UTF-8 bytes.

A word is a run of bytes of a class, so no text is taken apart row by row. Every word has a 64-bit code, a
polynomial over its bytes passed through a mixer; equal words have equal codes, and two different words share one
with a chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Bytes of one Arrow batch, unless the session asks for another bound than Spark's 64 MB.
BATCH_BYTES = 4 << 20

#: Bytes that part words in most contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: Letters, digits and all non-ASCII bytes; everything else parts words. For texts in lower case.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def in_arrow(rows: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """`rows.mapInArrow`, with batches bounded by bytes, so that long texts don't add up in a worker."""
    spark, key = rows.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offset of each row, nulls as empty texts."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes of text each; a longer text has a range of its own."""
    _, offsets = buffers(column)
    low, n = 0, len(column)
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


@dataclass
class Runs:
    """Runs of bytes: where each starts and ends, its code, and the first run of each row."""

    starts: np.ndarray
    ends: np.ndarray
    codes: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums, from which `span_codes` takes the code of any span."""
    powers, _ = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return sums


def span_codes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Codes of the spans of bytes, never zero."""
    _, inverse = _power_tables(len(sums))
    codes = mixed((sums[ends] - sums[starts]) * inverse[starts])
    return np.where(codes == 0, np.uint64(1), codes)


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, sums: np.ndarray | None = None) -> Runs:
    """Runs of bytes with `inside` set; none crosses the end of a row."""
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    sums = prefix_sums(data) if sums is None else sums
    return Runs(starts, ends, span_codes(sums, starts, ends), np.searchsorted(starts, offsets))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, alnum: bool = False) -> Runs:
    """Words of each row: split at blanks, or with `alnum` runs of letters and digits."""
    data = LOWER[data] if lower else data
    return runs(data, offsets, ALNUM[data] if alnum else ~BLANK[data])


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of `values` per row, zero for empty rows."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
