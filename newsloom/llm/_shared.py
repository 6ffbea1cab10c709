"""What the operators share: column names, vectorised reading of Arrow text columns, hashes; and the library's tables that cut lineage."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.storage import Stored, stored  # noqa: F401

#: UTF-8 bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# --- column names ------------------------------------------------------------------------------


def quoted(name: str) -> str:
    """The name as it stands in expressions, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame, names: list[str] | None = None) -> list:
    return [F.col(quoted(c)) for c in (df.columns if names is None else names)]


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Names like these that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return tuple(out)


# --- folds and typed columns -------------------------------------------------------------------


def fold(column, parts: int):
    """crc32 of the id as text, modulo ``parts``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts, F.lit(0))


def documents_of(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


# --- Arrow text columns as bytes ----------------------------------------------------------------


def steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch of about ``most`` bytes of text, each as (slice, bytes, offsets). Null texts are empty."""
    col = batch.column(column)
    if col.type != pa.large_string():
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and offs[-1] else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def lean(run: Callable) -> Callable:
    """A partition function that gives freed memory back when it ends: Python workers outlive their tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: what is made of them as Python objects stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the maximal runs of other than ``space``, and the row of each; no run spans two rows."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    gap = space[data]
    first = np.ones(n + 1, bool)
    first[1:n] = gap[:-1]
    first[offs[(offs < n)]] = True
    starts = np.flatnonzero(first[:n] & ~gap)
    last = np.ones(n + 1, bool)
    last[1:n] = gap[1:]
    last[offs] = True
    ends = np.flatnonzero(last[1:] & ~gap) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Keys of two independent hashes.
_KEYS = ((np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)), (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)))
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def lanes_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; beyond the end they are 0."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,)).copy()  # aligned, or each look-up would copy it


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, lanes: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte range: every eight bytes are mixed with their place, then summed, then mixed with the length.

    ``which`` chooses one of two independent hashes. Not a polynomial: texts of a regular form collide as rarely as others.
    """
    odd, add = _KEYS[which]
    size = (ends - starts).astype(np.int64)
    out = size.astype(np.uint64) * odd + add
    some = np.flatnonzero(size > 0)
    if len(some):
        lanes = lanes_of(data) if lanes is None else lanes
        size = size[some]
        per = (size + 7) >> 3
        last = np.cumsum(per)
        first = last - per
        place = np.arange(last[-1]) - np.repeat(first, per)
        chunk = lanes[np.repeat(starts[some], per) + 8 * place]
        chunk[last - 1] &= _MASKS[size - 8 * (per - 1)]
        salt = mix(np.arange(int(per.max()), dtype=np.uint64) * odd + add)
        out[some] += np.add.reduceat(mix(chunk ^ salt[place]), first)
    return mix(out)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending: by sorting, which is faster here than numpy's hashing."""
    v = np.sort(values)
    return v[np.r_[True, v[1:] != v[:-1]]] if len(v) else v


def code_points(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Code points of each row."""
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return np.diff(lead[offs])


def counts_by_row(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema.field(k).type) for k, x in columns.items()], schema=schema)
