"""Line dedup that can be undone: exact reference tables, with sharded cuckoo filters in front of them.

A line's key is the line stripped of white space at both ends, A-Z lower-cased; keys of at least MIN_CHARS code
points count, and stand as 128-bit hashes. The index holds, as tables in the shared folder,

* ``postings``: for each insert, (key, documents that hold it, block by block): the exact references;
* ``gone``: deleted documents, with the number of inserts that the deletion covers;
* ``segments``: for each insert and deletion, (key, refs, min_doc, version): the exact reference counts. The row
  of the latest version holds; refs 0 means that nobody holds the key any more;
* ``filters``: one cuckoo filter for each shard with the keys that have references.

``insert`` asks the filters which keys of a new batch may be known already. Only those are looked up in the exact counts
and added to them; the others are new for certain, and their counts are the batch's own. ``delete`` takes documents'
references away: it recounts the keys that they held, and keys without references leave the filters, so that the index
answers as if the documents had never come. Both append tables and rewrite none; segments merge when there are
many. ``apply`` drops the lines whose key has two references or more, but in the smallest document that holds it.

Skew: a block of documents posts a key once, with the list of its documents, so a line that is everywhere gives one
row for each block; counting pre-aggregates before the shuffle; the join that answers the postings has one row of
counts for each key, and AQE splits a hot key's side. Shards are by hash over distinct keys, hence even; their
number doubles as keys grow, and the filters are then built anew.

Defined cases: a null or empty text is one empty line; lines with shorter keys always stay; repeated rows of one
doc_id are one document, each gets the same lines dropped; inserting an id that the index holds replaces that document;
a null doc_id takes no part and keeps all its lines; an empty table gives no rows; extra columns of any name are
kept by ``apply`` and otherwise ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm._shared import LOWER, Stored, columns_of, documents_of, lanes_of, lean, mix, quoted, range_hashes, steps, unused, words

if TYPE_CHECKING:  # workers of Arrow functions don't need it
    import pandas as pd

MIN_CHARS = 10
#: UTF-8 bytes of text whose postings of one key share a row, keys of a shard, and segments that are kept apart.
BLOCK_BYTES, SHARD_KEYS, SEGMENTS = 8 << 20, 400_000, 8
#: Batches in which a table is inserted.
BATCHES = 2
#: Cuckoo filter: slots of a bucket, 16-bit fingerprints, load at most, moves before it grows.
SLOTS, LOAD, MOVES = 4, 0.85, 200
POSTINGS = "hi long, lo long, docs array<long>, batch int"
FILTERS = "shard int, filter binary"
KEY = ["hi", "lo"]


class Cuckoo:
    """A cuckoo filter over 64-bit key hashes: no false negatives, deletions of inserted keys."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets  # a power of two
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @staticmethod
    def sized(keys: int) -> Cuckoo:
        return Cuckoo(1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD))))))

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @staticmethod
    def from_bytes(blob: bytes) -> Cuckoo:
        table = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()
        return Cuckoo(len(table), table)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets; the buckets follow from each other and the fingerprint."""
        k = keys.astype(np.uint64)
        fp = (k >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        one = (k & np.uint64(self.buckets - 1)).astype(np.int64)
        return fp, one, self._other(one, fp)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return bucket ^ (fp.astype(np.int64) * 0x5BD1E995 & (self.buckets - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, one, two = self._places(keys)
        return (self.table[one] == fp[:, None]).any(1) | (self.table[two] == fp[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False, with some keys missing, if the table is too full."""
        fp, one, two = self._places(keys)
        for second in (False, True):  # whole rounds first: each free slot takes one key
            for slot in range(SLOTS):
                if not len(fp):
                    return True
                bucket = two if second else one
                free = np.flatnonzero(self.table[bucket, slot] == 0)
                _, pick = np.unique(bucket[free], return_index=True)
                chosen = free[pick]
                self.table[bucket[chosen], slot] = fp[chosen]
                rest = np.delete(np.arange(len(fp)), chosen)
                fp, one, two = fp[rest], one[rest], two[rest]
        rng = np.random.default_rng(1)
        for f, b in zip(fp.tolist(), two.tolist(), strict=True):
            for _ in range(MOVES):
                free = np.flatnonzero(self.table[b] == 0)
                if len(free):
                    self.table[b, free[0]] = f
                    break
                slot = int(rng.integers(SLOTS))
                f, self.table[b, slot] = int(self.table[b, slot]), f
                b = int(self._other(np.array([b]), np.array([f], np.uint16))[0])
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        for f, a, b in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == f)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break


def built(keys: np.ndarray, room: int = 0) -> Cuckoo:
    """A filter of these keys; it doubles until they fit."""
    size = max(len(keys), room, 1)
    while True:
        f = Cuckoo.sized(size)
        if f.insert(keys):
            return f
        size *= 2


# --- lines of Arrow text ------------------------------------------------------------------------


def read_lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every line. A row without text has one empty line."""
    brk = np.flatnonzero(data == 10)
    n = len(offs) - 1
    starts, row = np.concatenate([offs[:-1], brk + 1]), np.concatenate([np.arange(n), np.searchsorted(offs, brk, "right") - 1])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    ends = offs[row + 1].copy()
    ends[:-1] = np.where(last[:-1], ends[:-1], starts[1:] - 1)
    return starts, ends, row


def line_keys(data: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines with a key that counts: their numbers and both halves of the key."""
    low = LOWER[data]
    ws, we, _ = words(low, offs)  # a newline separates words, so none spans two lines
    first, after = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    at = np.flatnonzero(after > first)
    a, b = ws[first[at]], we[after[at] - 1]
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    counts = lead[b] - lead[a] >= MIN_CHARS
    at, a, b = at[counts], a[counts], b[counts]
    lanes = lanes_of(low)
    return at, range_hashes(low, a, b, 0, lanes).view(np.int64), range_hashes(low, a, b, 1, lanes).view(np.int64)


def _postings(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each key of a block of documents once for each batch, with the ids of its documents."""
        held: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            doc, hi, lo = np.concatenate(held, 1)
            part = (mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((doc, lo, hi, part))
            doc, hi, lo, part = doc[order], hi[order], lo[order], part[order]
            new_key = np.ones(len(doc), bool)
            new_key[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (part[1:] != part[:-1])
            fresh = new_key.copy()
            fresh[1:] |= doc[1:] != doc[:-1]
            starts = np.flatnonzero(new_key[fresh])
            doc, hi, lo, part = doc[fresh], hi[fresh], lo[fresh], part[fresh]
            for a in range(0, len(starts), 20_000):
                some = np.append(starts[a : a + 20_000], starts[a + 20_000] if a + 20_000 < len(starts) else len(doc))
                lists = pa.ListArray.from_arrays(pa.array((some - some[0]).astype(np.int32)), pa.array(doc[some[0] : some[-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(hi[some[:-1]]), pa.array(lo[some[:-1]]), lists, pa.array(part[some[:-1]].astype(np.int32))], names=["hi", "lo", "docs", "batch"])

        for batch in batches:
            for part, data, offs in steps(batch):
                ids = part["doc_id"].fill_null(0).to_numpy()
                known = part["doc_id"].is_valid().to_numpy(zero_copy_only=False)
                starts, ends, row = read_lines(data, offs)
                at, hi, lo = line_keys(data, offs, starts, ends)
                take = known[row[at]]
                if take.any():
                    held.append(np.stack([ids[row[at[take]]], hi[take], lo[take]]))
                size += len(data)
                if size >= BLOCK_BYTES and held:
                    yield from out()
                    held.clear()
                    size = 0
        if held:
            yield from out()

    return run


def _kept(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines whose keys are in the column ``names[0]``."""
    drop_name, doc_name, *new = names
    for batch in batches:
        for part, data, offs in steps(batch):
            starts, ends, row = read_lines(data, offs)
            gone = np.zeros(len(starts), bool)
            drops = part[drop_name]
            if drops.null_count < len(drops):
                lists = drops.fill_null([])
                flat = lists.flatten()
                per = np.diff(lists.offsets.to_numpy())
                owner = np.repeat(np.arange(len(drops)), per)
                at, hi, lo = line_keys(data, offs, starts, ends)
                gone[at] = np.isin(_of_row(row[at], hi, lo), _of_row(owner, flat.field(0).to_numpy(), flat.field(1).to_numpy()))
            n_lines = np.bincount(row, minlength=part.num_rows)
            n_dropped = np.bincount(row[gone], minlength=part.num_rows)
            texts = _without(data, offs, starts, ends, row, gone)
            rest = [k for k in part.schema.names if k not in (drop_name, doc_name)]
            yield pa.RecordBatch.from_arrays([*(part[k] for k in rest), texts, pa.array(n_lines.astype(np.int64)), pa.array(n_dropped.astype(np.int64))], names=[*rest, *new])


def _of_row(row: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mix(mix(row.astype(np.uint64) + np.uint64(3)) ^ hi.view(np.uint64)) ^ mix(lo.view(np.uint64) + np.uint64(7))


def _without(data: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, gone: np.ndarray) -> pa.Array:
    """The rows' remaining lines, joined by a newline. A line takes the newline before it along; the first that stays has none."""
    if gone.any():
        stays = np.cumsum(~gone)
        head = np.zeros(len(offs) - 1, np.int64)  # lines that stay before each row's first
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        head[row[first]] = stays[first] - ~gone[first]
        leads = stays - ~gone > head[row]  # an earlier line of the row stays
        keep = np.zeros(len(data) + 1, np.int64)
        for at, sign in ((starts[~gone], 1), (ends[~gone], -1)):
            np.add.at(keep, at, sign)
        mark = np.cumsum(keep[:-1]) > 0
        mark[starts[~gone & leads] - 1] = True
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mark, out=total[1:])
        data, offs = data[mark], total[offs]
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(data.tobytes())).cast(pa.string())


# --- the index ----------------------------------------------------------------------------------


def _count(postings: DataFrame) -> DataFrame:
    return postings.groupBy(*KEY).agg(F.sum(F.size("docs")).alias("refs"), F.min(F.array_min("docs")).alias("min_doc"))


def _maybe(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """Keys of a batch in one shard, and whether the shard's filter may hold them."""
    known = Cuckoo.from_bytes(old["filter"].iloc[0]).contains(new["hi"].to_numpy()) if len(old) else np.zeros(len(new), bool)
    return new.assign(maybe=known)


def _grown(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """The shard's filter with the new keys in it; null if it is too full for them."""
    import pandas as pd

    if not len(old):
        return pd.DataFrame({"shard": [int(new["shard"].iloc[0])], "filter": [built(new["hi"].to_numpy()).to_bytes()]})
    f = Cuckoo.from_bytes(old["filter"].iloc[0])
    return old.assign(filter=[f.to_bytes() if not len(new) or f.insert(new["hi"].to_numpy()) else None])


def _rebuilt(keys: pd.DataFrame) -> pd.DataFrame:
    import pandas as pd

    return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "filter": [built(keys["hi"].to_numpy()).to_bytes()]})


def _shrunk(gone: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    if not len(old) or not len(gone):
        return old
    f = Cuckoo.from_bytes(old["filter"].iloc[0])
    f.delete(gone["hi"].to_numpy())
    return old.assign(filter=[f.to_bytes()])


class LineIndex:
    """References of lines to documents. Changes append tables; ``drop`` removes all of them."""

    def __init__(self, shard_keys: int = SHARD_KEYS):
        self.shard_keys, self.shards, self.keys, self.version = shard_keys, 0, 0, 0
        self.postings: list[DataFrame] = []
        self.gone: list[tuple[int, Stored]] = []
        self.segments: list[Stored] = []
        self.filters: Stored | None = None
        self._tables: list[Stored] = []

    def drop(self) -> None:
        for t in [*self._tables, *self.segments, *(g for _, g in self.gone), *([self.filters] if self.filters else [])]:
            t.drop()

    # -- changes

    def insert(self, docs: DataFrame, batches: int = 1) -> LineIndex:
        """Adds documents; those whose id the index holds are replaced. In ``batches`` parts by hash of the id, read once."""
        docs = documents_of(docs)
        again = Stored(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
        if self.postings:
            held = Stored(self._references().select("doc_id").join(docs.select("doc_id"), "doc_id", "left_semi").distinct())
            if not held.df.isEmpty():
                self.delete(held.df)
            held.drop()
        if again.df.isEmpty():
            rows = docs.mapInArrow(lean(_postings(batches)), POSTINGS)
        else:  # rows of one id in several blocks: each reference once
            rows = docs.join(again.df, "doc_id", "left_anti").mapInArrow(lean(_postings(batches)), POSTINGS)
            rest = docs.join(again.df, "doc_id", "left_semi").mapInArrow(lean(_postings(batches)), POSTINGS)
            rest = rest.select(*KEY, F.explode("docs").alias("doc"), "batch").distinct()
            rows = rows.unionByName(rest.select(*KEY, F.array("doc").alias("docs"), "batch"))
        raw = Stored(rows, ["batch"] if batches > 1 else None)
        again.drop()
        self._tables.append(raw)
        for k in range(batches):
            self._add((raw.df.where(F.col("batch") == k) if batches > 1 else raw.df).select(*KEY, "docs"))
        return self

    def _add(self, postings: DataFrame) -> None:
        self.version += 1
        self.postings.append(postings)
        batch = Stored(_count(postings))
        n = batch.df.count()
        if not self.segments:
            self._append(batch.df.withColumn("version", F.lit(self.version)))
            self.keys += n
            self._rebuild()
            batch.drop()
            return
        schema = T.StructType([*batch.df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("maybe", T.BooleanType())])
        marked = Stored(self._sharded(batch.df).groupBy("shard").cogroup(self.filters.df.groupBy("shard")).applyInPandas(_maybe, schema))
        maybe = marked.df.where("maybe").select(*KEY, "refs", "min_doc")
        # exact counts of the keys in question; what isn't there after all was a false positive
        known = Stored(self._counts(maybe.select(*KEY)))
        sums = maybe.unionByName(known.df).groupBy(*KEY).agg(F.sum("refs").alias("refs"), F.min("min_doc").alias("min_doc"))
        self._append(marked.df.where("not maybe").select(*KEY, "refs", "min_doc").unionByName(sums).withColumn("version", F.lit(self.version)))
        new = marked.df.where("not maybe").select("shard", *KEY).unionByName(marked.df.where("maybe").select("shard", *KEY).join(known.df, KEY, "left_anti"))
        self.keys += n - known.df.count()
        if self.keys > 2 * self.shards * self.shard_keys:
            self._rebuild()
        else:
            self._grow(new)
        for t in (batch, marked, known):
            t.drop()

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """``doc_ids``: a column doc_id. Ids that the index doesn't hold change nothing."""
        if not self.postings:
            return self
        ids = Stored(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct())
        touched = Stored(self._references().join(ids.df, "doc_id", "left_semi").select(*KEY).distinct())
        self.version += 1
        self.gone.append((len(self.postings), ids))
        left = self._references(touched.df).groupBy(*KEY).agg(F.count("*").alias("refs"), F.min("doc_id").alias("min_doc"))
        fresh = Stored(touched.df.join(left, KEY, "left").select(*KEY, F.coalesce("refs", F.lit(0)).alias("refs"), "min_doc", F.lit(self.version).alias("version")))
        lost = self._sharded(fresh.df.where("refs = 0").select(*KEY))
        filters = Stored(lost.groupBy("shard").cogroup(self.filters.df.groupBy("shard")).applyInPandas(_shrunk, FILTERS))
        self.keys -= fresh.df.where("refs = 0").count()
        self.filters.drop()
        self.filters = filters
        self._append(fresh.df)
        fresh.drop()
        touched.drop()
        return self

    # -- tables

    def _sharded(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.col("lo"), F.lit(self.shards)).cast("int"))

    def _references(self, keys: DataFrame | None = None) -> DataFrame:
        """hi, lo, doc_id of all documents that are not deleted (of some keys)."""
        out = None
        for i, p in enumerate(self.postings):
            p = p if keys is None else p.join(keys, KEY, "left_semi")
            p = p.select(*KEY, F.explode("docs").alias("doc_id"))
            for upto, ids in self.gone:
                if i < upto:
                    p = p.join(ids.df, "doc_id", "left_anti").select(*KEY, "doc_id")
            out = p if out is None else out.unionByName(p)
        return out

    def _counts(self, keys: DataFrame | None = None) -> DataFrame:
        """hi, lo, refs, min_doc by the latest version (of some keys)."""
        frames = [s.df if keys is None else s.df.join(keys, KEY, "left_semi") for s in self.segments]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        if len(frames) > 1:
            out = out.groupBy(*KEY).agg(F.max(F.struct("version", "refs", "min_doc")).alias("r")).select(*KEY, "r.refs", "r.min_doc")
        return out.where("refs > 0").select(*KEY, "refs", "min_doc")

    def counts(self) -> DataFrame:
        return self._counts()

    def _append(self, rows: DataFrame) -> None:
        self.segments.append(Stored(rows.select(*KEY, F.col("refs").cast("long").alias("refs"), "min_doc", F.col("version").cast("int").alias("version"))))
        if len(self.segments) > SEGMENTS:
            whole = Stored(self._counts().withColumn("version", F.lit(self.version)))
            for s in self.segments:
                s.drop()
            self.segments = [whole]

    def _rebuild(self) -> None:
        """Filters of all keys, in as many shards as they need."""
        self.shards = max(1, -(-self.keys // self.shard_keys))
        filters = Stored(self._sharded(self._counts().select(*KEY)).select("shard", "hi").groupBy("shard").applyInPandas(_rebuilt, FILTERS))
        if self.filters:
            self.filters.drop()
        self.filters = filters

    def _grow(self, keys: DataFrame) -> None:
        grown = Stored(keys.select("shard", "hi").groupBy("shard").cogroup(self.filters.df.groupBy("shard")).applyInPandas(_grown, FILTERS))
        full = grown.df.where("filter is null").select("shard")
        if not full.isEmpty():  # what is too full is built again from the exact keys
            again = self._sharded(self._counts().select(*KEY)).select("shard", "hi").join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_rebuilt, FILTERS)
            whole = Stored(grown.df.where("filter is not null").unionByName(again))
            grown.drop()
            grown = whole
        self.filters.drop()
        self.filters = grown

    # -- answers

    def drops(self) -> DataFrame:
        """doc_id, drop: the keys (as hi, lo) that each document loses."""
        twice = self._counts().where("refs >= 2").select(*KEY, "min_doc")
        if self.gone:
            hit = self._references().join(twice, KEY)
        else:  # the lists of a key answer at once
            whole = self.postings[0]
            for p in self.postings[1:]:
                whole = whole.unionByName(p)
            hit = whole.join(twice, KEY).withColumn("doc_id", F.explode("docs"))
        return hit.where("doc_id <> min_doc").groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("drop"))

    def apply(self, docs: DataFrame, names: tuple[str, str, str] = ("kept_text", "n_lines", "n_dropped")) -> DataFrame:
        """``docs`` with three more columns: the kept lines, the number of lines before, and of those dropped. ``names`` must be new."""
        drop, doc = unused(docs, "drop", "of_doc")
        if self.postings:
            found = self.drops().select(F.col("doc_id").alias(doc), F.col("drop").alias(drop))
            joined = docs.join(found, F.col("doc_id").cast("long") == F.col(doc), "left").select(*columns_of(docs), F.col(quoted(drop)))
        else:
            joined = docs.withColumn(drop, F.lit(None).cast("array<struct<hi: long, lo: long>>"))
        # Arrow functions take plain names only
        plain = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
        new = ("kept_text", "n_lines", "n_dropped")
        fields = [T.StructField(n, f.dataType) for n, f in zip(plain, docs.schema.fields, strict=True)]
        schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in zip(new, (T.StringType(), T.LongType(), T.LongType()), strict=True))])
        return joined.toDF(*plain, "drop").mapInArrow(lean(_Kept(("drop", "of_doc", *new))), schema).toDF(*docs.columns, *names)


class _Kept:
    def __init__(self, names: tuple[str, ...]):
        self.names = names

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _kept(batches, self.names)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (kept lines)."""
    index = LineIndex().insert(docs, BATCHES)
    return index.apply(documents_of(docs)).select("doc_id", "n_lines", "n_dropped", F.col("kept_text").alias("text"))
