"""Periodic runs of words, found on a harmonic grid with prefix hashes.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) and at least ``max(LEAST, TIMES * q)``
words, which no neighbouring word extends. For a period q, the grid points of a text are its words 0, q, 2q, ...: a run of
four periods holds three whole grid steps, so all grid points of all periods (n ln n of them) find every run.

* Words become numbers by an exact dictionary; prefix sums of two polynomial hashes are built for a whole step of texts at once.
* All (period, grid point) pairs of a step are numpy arrays: pairs whose three grid words differ go first, then those whose next
  two periods differ by hash. For the rest the longest common extensions forward and backward are searched by halving, all
  pairs at the same time.
* Runs that several grid points or multiples of a period found are one; every run is verified word by word, and a text
  with a run that the words don't bear out (a collision) is searched again without hashes.

Texts are read whole. Pairs are worked on in chunks of ``PAIRS``, so memory follows the longest text only. No shuffle.

Defined cases: a null or empty text, or one without words, has no words, no runs and an empty collapsed text; a null doc_id is
treated like any; repeated rows are each searched; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import let
from newsloom.llm._shared import documents_of, lean, mix, steps, words

#: Words of a run at least, and periods.
LEAST, TIMES = 6, 4
#: (period, grid point) pairs of a chunk.
PAIRS = 1 << 20
#: Two primes under 2 to the power of 31, so products fit 64 bits, and the bases of their hashes.
PRIMES = (np.uint64(2147483647), np.uint64(2147483629))
BASES = (np.uint64(1_103_515_245), np.uint64(1_664_525_017))
FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@lru_cache(maxsize=4)
def _powers(which: int, size: int) -> np.ndarray:
    p, out, n = PRIMES[which], np.ones(size, np.uint64), 1
    while n < size:
        more = min(n, size - n)
        out[n : n + more] = out[:more] * (out[n - 1] * BASES[which] % p) % p
        n += more
    return out


class Prefixes:
    """Two prefix hashes of a sequence of numbers; ``same`` compares stretches that lie ``q`` apart."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        size = 1 << max(10, n.bit_length())
        self.parts = []
        for which, p in enumerate(PRIMES):
            power = _powers(which, size)
            value = mix(ids.astype(np.uint64) + np.uint64(1 + 7919 * which)) % p
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(value * power[:n] % p, out=sums[1:])
            self.parts.append((p, power, sums % p))

    def same(self, at: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` numbers from ``at`` on equal those from ``at + q`` on, by hash."""
        out = np.ones(len(at), bool)
        for p, power, sums in self.parts:
            here, there = sums[at + size] + p - sums[at], sums[at + q + size] + p - sums[at + q]
            out &= here % p * power[q] % p == there % p
        return out

    def extent(self, at: np.ndarray, q: np.ndarray, known: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The longest common extension forward from (or backward to) ``at`` and ``at + q``, between ``known`` and ``most``."""
        low, high = known.copy(), most.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_] + 1) >> 1
            good = self.same(at[open_] - mid if back else at[open_], q[open_], mid)
            low[open_[good]] = mid[good]
            high[open_[~good]] = mid[~good] - 1
        return low


def _spread(first: np.ndarray, count: np.ndarray, step: np.ndarray | int = 1) -> tuple[np.ndarray, np.ndarray]:
    """first, first + step, ... ``count`` of each row, and the row of each."""
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return first[row] + place * (step[row] if isinstance(step, np.ndarray) else step), row


def _unique(runs: np.ndarray) -> np.ndarray:
    """One row (start, end, period) for each start and end, the one with the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1)]] if len(runs) else runs


def direct(ids: np.ndarray) -> np.ndarray:
    """The runs of one text without hashes, in quadratic time: for a text in which hashes collided."""
    found = []
    for q in range(1, len(ids) // TIMES + 1):
        edge = np.flatnonzero(np.diff(np.r_[False, ids[q:] == ids[:-q], False].astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b + q - a >= max(LEAST, TIMES * q):
                found.append((a, b + q, q))
    return _unique(np.array(found, np.int64).reshape(-1, 3))


def verified(ids: np.ndarray, runs: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which runs the words bear out: equal a period apart all along, and not beyond."""
    start, end, q = runs.T
    good = np.ones(len(runs), bool)
    inside = np.flatnonzero(start > first)
    good[inside] &= ids[start[inside] - 1] != ids[start[inside] - 1 + q[inside]]
    inside = np.flatnonzero(end < last)
    good[inside] &= ids[end[inside]] != ids[end[inside] - q[inside]]
    total, at = np.cumsum(end - q - start), 0
    while at < len(runs):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 4 * PAIRS, "right")))
        place, row = _spread(start[at:to], (end - q - start)[at:to])
        good[at + row[ids[place] != ids[place + q[at:to][row]]]] = False
        at = to
    return good


def find_runs(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs of the texts whose words end at ``ends`` (from 0), ordered by start, then period."""
    first, n = ends[:-1], np.diff(ends)
    per = np.where(n >= LEAST, n // TIMES, 0)
    text = np.repeat(np.arange(len(n)), per)
    period = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per) + 1
    points = n[text] // period - 2  # three periods from each point on lie in the text
    total = np.cumsum(points)
    hashes, found, at = None, [np.zeros((0, 3), np.int64)], 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        where, row = _spread(first[text[at:to]], points[at:to], period[at:to])
        q = period[at:to][row]
        hit = np.flatnonzero(ids[where] == ids[where + q])
        where, row, q = where[hit], row[hit], q[hit]
        hit = np.flatnonzero(ids[where] == ids[where + 2 * q])
        where, row, q = where[hit], row[hit], q[hit]
        if len(where):
            hashes = hashes or Prefixes(ids)
            hit = np.flatnonzero(hashes.same(where, q, 2 * q))
            where, q, row = where[hit], q[hit], row[hit]
            # the next grid point of the same period lies inside the extension of the one before
            hit = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (where[1:] != where[:-1] + q[1:])][: len(row)])
            where, q, of = where[hit], q[hit], text[at:to][row[hit]]
            forward = hashes.extent(where, q, 2 * q, ends[of + 1] - where - q, False)
            backward = hashes.extent(where, q, np.zeros(len(q), np.int64), where - first[of], True)
            runs = np.c_[where - backward, where + q + forward, q]
            found.append(_unique(runs[runs[:, 1] - runs[:, 0] >= np.maximum(LEAST, TIMES * q)]))
        at = to
    runs = _unique(np.concatenate(found))
    if len(runs):
        of = np.searchsorted(ends, runs[:, 0], "right") - 1
        if len(bad := np.unique(of[~verified(ids, runs, first[of], ends[of + 1])])):
            again = [direct(ids[ends[i] : ends[i + 1]]) + [ends[i], ends[i], 0] for i in bad.tolist()]
            runs = np.concatenate([runs[~np.isin(of, bad)], *again])
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(total: int, runs: np.ndarray) -> np.ndarray:
    """Words that no run holds after its first period."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    return np.cumsum(change)[:total] == 0


def _number(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of each word in a dictionary of the words themselves."""
    size = ends - starts
    place, _ = _spread(starts, size)
    offsets = np.r_[0, np.cumsum(size)]
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[place])])
    return array.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """The words of each of ``n`` rows joined by one space."""
    last = np.r_[row[1:] != row[:-1], True][: len(row)]
    size = ends - starts + ~last
    place, word = _spread(starts, size)
    out = np.r_[data, np.uint8(0)][place]
    out[(np.cumsum(size) - 1)[~last]] = 0x20
    bounds = np.r_[0, np.cumsum(np.bincount(row[word], minlength=n))]
    return pa.StringArray.from_buffers(n, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offs in steps(batch):
            ws, we, row = words(data, offs)
            ends = np.searchsorted(row, np.arange(len(offs)))
            runs = find_runs(_number(data, ws, we), ends)
            of = np.searchsorted(ends, runs[:, 0], "right") - 1
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(of, np.arange(len(offs))), pa.int32()),
                pa.StructArray.from_arrays([pa.array(runs[:, 0] - ends[of]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], fields=list(RUN)),
            )
            stay = kept_words(len(ws), runs)
            text = _joined(data, ws[stay], we[stay], row[stay], len(offs) - 1)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.diff(ends), pa.int64()), lists, text], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: the text's words but for repeats in runs."""
    return documents_of(docs).mapInArrow(lean(_search), FOUND)


def damaged(docs: DataFrame) -> DataFrame:
    """The documents, one text in ten with periods planted by its id: words from some place on repeat those after it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(found):
        n = F.size(found)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(found, F.when(i < a, i).otherwise(a + (i - a) % p)))
        return F.when(n > 0, F.array_join(again, " ")).otherwise("")

    text = let(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), planted)
    return documents_of(docs).select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    order = lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))
    longest = F.array_max(F.transform("runs", order))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    first = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("r.length") / -F.col("r.p")).cast("long")
    return first.select("doc_id", "n_runs", (-F.col("r.s")).alias("start"), F.col("r.length").alias("length"), (-F.col("r.p")).alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
