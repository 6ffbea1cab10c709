"""Near-duplicate documents by min-max hashing, banding, and exact comparison of full shingle sets.

Under each permutation both the smallest and the largest value of a document's shingles are kept: two components
for one hash evaluation, each an unbiased vote on the similarity, with less variance together than two minima.
Bands of ``ROWS`` components make bucket keys, as many that a pair at the bound shares no bucket with a probability
of about 1e-5: 24 at a similarity of 0.85, 38 at 0.80.

* Equal sets become one class first (grouped minimum), so copies are never compared.
* Each class that shares a bucket is compared with the smallest class of any of its buckets, on full sets. These stars
  settle most links; a centre of very many is dealt to chunks.
* Buckets whose classes are all linked by then are done. In the others, classes meet bucket by bucket with their signatures alone
  (two bytes a component): pairs of two linked groups whose signatures agree in ``AGREE`` of the components or more are candidates; a
  pair at the bound agrees in fewer with a probability of about 1e-6. A forest of these goes on, no list of pairs. So a bucket costs one or two short rows for each member, however few of them are alike. A
  bucket of more than ``MEET`` classes is dealt to parts; its largest linked group is compared with the rest only.
* Candidates join linked groups to clusters; a cluster's largest linked group needs no comparing inside itself. It and the rest are dealt to blocks of
  bounded size; every pair of a block of the group with one of the rest, and of two of the rest, is one unit of work, in which all
  pairs are compared on full sets in numpy. It returns a spanning forest of the links, at most one edge for each document.
* Linked groups that these edges join are the result: any two classes that share a bucket have met, are linked, or differ by their signatures.

A class is known by a number of its own, not by a doc_id: two texts under one id are two classes, and each row has the verdict of its own text.

Shingles are compared as 64-bit hashes: two different ones agree with a probability of 2 to the power of -64.

Defined cases: a null or empty text, or one without words, has no shingles and is linked with nothing; with fewer
words than a shingle has, the whole sequence is the only one; a row with a null doc_id is linked with nothing and kept;
repeated rows of one doc_id and text share a verdict, those of different texts have one each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm._shared import LOWER, Stored, batch_of, distinct, documents_of, lean, mix, range_hashes, slices, steps, words
from newsloom.llm.graph import components

SHINGLE, PERCENT = 5, 85
#: Bands by the bound in per cent.
BANDS, ROWS = {85: 24, 80: 38}, 6
#: Documents of a block, and shingles of a block as far as documents allow.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1_000_000
#: Members of a centre that are compared in one task.
CHUNK = 2000
#: Bits of the bitmap of wanted ids, at most (8 MB).
SLOTS = 1 << 26
#: Classes of a bucket that meet in one unit, and the share of components that agree at least, by the bound in per cent.
MEET, AGREE = 4096, {85: 0.70, 80: 0.66}
SIGNED = "doc_id long, hi long, lo long, n_shingles long, bands array<long>, parts binary"
SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64())), ("parts", pa.binary())])


@lru_cache
def permutations(bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Flips and odd factors of the permutations that so many bands need."""
    rng = np.random.default_rng(20)
    flip = rng.integers(0, 1 << 63, bands * ROWS // 2, np.uint64)
    return flip, rng.integers(0, 1 << 63, bands * ROWS // 2, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending in the row, and the rows' offsets into them."""
    low = LOWER[data]
    ws, we, row = words(low, offs)
    n = len(offs) - 1
    first, total = np.searchsorted(row, np.arange(n + 1)), len(ws)
    count = np.diff(first)
    h = range_hashes(low, ws, we)
    sums = np.zeros(max(0, total - k + 1), np.uint64)
    for i in range(k):
        sums = mix(sums * np.uint64(3) + h[i : total - k + 1 + i] if total >= k else sums)
    whole = row[k - 1 :] == row[: total - k + 1] if total >= k else np.zeros(0, bool)
    values, rows = sums[whole], row[: len(sums)][whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        one = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = count[short] > i
            one[has] = mix(one[has] * np.uint64(3) + h[first[short[has]] + i] + np.uint64(0x51ED27))
        values, rows = np.r_[values, one], np.r_[rows, short]
        order = np.argsort(rows, kind="stable")
        values, rows = values[order], rows[order]
    cuts = np.searchsorted(rows, np.arange(n + 1))
    out = [distinct(values[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    ends = np.zeros(n + 1, np.int64)
    np.cumsum([len(x) for x in out], out=ends[1:])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), ends


def min_max(values: np.ndarray, starts: np.ndarray, bands: int) -> np.ndarray:
    """(rows, components): minima under all permutations, then maxima. Rows must not be empty."""
    flip, times = permutations(bands)
    half = len(flip)
    out = np.empty((len(starts), 2 * half), np.uint64)
    for i in range(half):
        p = (values ^ flip[i]) * times[i]
        out[:, i] = np.minimum.reduceat(p, starts)
        out[:, half + i] = np.maximum.reduceat(p, starts)
    return out


def band_keys(parts: np.ndarray) -> np.ndarray:
    """(rows, bands): each band takes as many minima as maxima, of different permutations."""
    half, bands = parts.shape[1] // 2, parts.shape[1] // ROWS
    order = np.concatenate([[j * ROWS // 2 + np.arange(ROWS // 2), half + ((j + 1) * ROWS // 2 + np.arange(ROWS // 2)) % half] for j in range(bands)], axis=None).reshape(bands, ROWS)
    keys = np.tile(mix(np.arange(bands, dtype=np.uint64)), (len(parts), 1))
    for r in range(ROWS):
        keys = mix(keys * np.uint64(5) + parts[:, order[:, r]])
    return keys


def set_hashes(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set. Rows must not be empty."""
    return np.add.reduceat(mix(values + np.uint64(11)), starts).view(np.int64), np.add.reduceat(mix(values ^ np.uint64(0xABCDEF)), starts).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offs in steps(batch):
            values, ends = shingles(data, offs)
            size = np.diff(ends)
            has, none = np.flatnonzero(size > 0), size == 0
            hi, lo, keys, parts = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), np.zeros((0, bands), np.uint64), np.zeros((0, bands * ROWS), np.uint64)
            if len(has):
                parts = min_max(values, ends[has], bands)
                keys = band_keys(parts)
                hi[has], lo[has] = set_hashes(values, ends[has])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(none, 0, bands))].astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
            short = (mix(parts) >> np.uint64(48)).astype(np.uint16)
            bounds = np.r_[0, np.cumsum(np.where(none, 0, 2 * bands * ROWS))].astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(short.tobytes())])
            yield batch_of(SIGNED_ARROW, doc_id=part["doc_id"], hi=pa.array(hi, mask=none), lo=pa.array(lo, mask=none), n_shingles=size, bands=lists, parts=blobs)


def _sets(batches: Iterator[pa.RecordBatch], bits: bytes) -> Iterator[pa.RecordBatch]:
    wanted = np.frombuffer(bits, np.uint8)
    for batch in batches:
        slot = batch.column("slot").to_numpy() - 1
        for part, data, offs in steps(batch.filter(pa.array(wanted[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1))):
            values, ends = shingles(data, offs)
            has = np.flatnonzero(np.diff(ends) > 0)
            if len(has):
                hi, lo = set_hashes(values, ends[has])
                blobs = [values[a:b].tobytes() for a, b in zip(ends[has].tolist(), ends[has + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(has)), pa.array(hi), pa.array(lo), pa.array(blobs, pa.binary())], names=["doc_id", "hi", "lo", "shingles"])


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], names=["a", "b"])


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets reach the bound."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _stars(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (centre, chunk, member or not) come in: a centre's set, then its members', one held at a time."""
    middle = None
    for batch in slices(batches):
        found = []
        for centre, doc, blob in zip(*(batch[k].to_pylist() for k in ("centre", "doc_id", "shingles")), strict=True):
            x = np.frombuffer(blob, np.uint64)
            if doc == centre:
                middle = x
            elif linked(x, middle, percent):
                found.append((doc, centre))
        if found:
            yield _edges(found)


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, over slices of the shingles that two sets or more share."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = count[back] > 1
    column, owner = number[back[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out, width = np.zeros((n, n), np.float64), 4096
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + width + 1, width))
    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if a < b:
            m = np.zeros((n, min(width, int(column[b - 1]) - i * width + 1)), np.float32)
            m[owner[a:b], column[a:b] - i * width] = 1
            out += m @ m.T
    return out.astype(np.int64)


def forest(ids: list[int], sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between these documents."""
    if len(ids) < 2:
        return []
    size = np.array([len(s) for s in sets])
    both = common(sets)
    near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for a, b in np.argwhere(np.triu(near, 1)).tolist():
        ra, rb = find(a), find(b)
        if ra != rb:
            root[rb] = ra
            edges.append((ids[a], ids[b]))
    return edges


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit come in; a unit's sets (two blocks of documents) are held at a time."""
    unit, ids, sets = None, [], []
    for batch in slices(batches):
        found = []
        for *key, doc, blob in zip(*(batch[k].to_pylist() for k in ("cluster", "side", "x", "y", "doc_id", "shingles")), strict=True):
            if key != unit:
                found += forest(ids, sets, percent)
                unit, ids, sets = key, [], []
            ids.append(doc)
            sets.append(np.frombuffer(blob, np.uint64))
        if found:
            yield _edges(found)
    if found := forest(ids, sets, percent):
        yield _edges(found)


def sets_of(docs: DataFrame, of_class: DataFrame) -> DataFrame:
    """doc_id (a class's number) and shingles: one set for each class, from the text under its id (rep) that has its hashes (hi, lo).

    Texts don't travel: a bitmap of the hashed ids, of bounded size, passes every row that is wanted and few others, and the join of sets decides.
    """
    most = max(1 << 15, min(SLOTS, 1 << int(16 * of_class.count()).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(most)) + 1
    built = of_class.select(slot("rep").alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    bits = bytearray(most >> 3)
    for r in built.toLocalIterator():
        bits[(r.bucket - 1) * 4096 : r.bucket * 4096] = r.bits
    read = docs.where("doc_id is not null").withColumn("slot", slot("doc_id")).mapInArrow(lean(partial(_sets, bits=bytes(bits))), "rep long, hi long, lo long, shingles binary")
    return read.join(of_class, ["rep", "hi", "lo"]).select("doc_id", "shingles").dropDuplicates(["doc_id"])


def star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (doc_id, centre) that reach the bound, as a and b. Members of a centre are dealt to chunks of about CHUNK."""
    chunks = Stored(pairs.groupBy("centre").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))).df
    members = pairs.join(chunks, "centre").select("centre", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int").alias("chunk"), "doc_id")
    centres = chunks.select("centre", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("centre").alias("doc_id"))
    rows = members.unionByName(centres).join(sets, "doc_id").select("centre", "chunk", "doc_id", "shingles")
    return rows.repartition("centre", "chunk").sortWithinPartitions("centre", "chunk", F.col("doc_id") != F.col("centre")).mapInArrow(lean(partial(_stars, percent=percent)), "a long, b long")


def _meet(batches: Iterator[pa.RecordBatch], agree: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit come in; a unit's signatures are held at a time. A spanning forest of the linked groups that may hold a link goes out."""
    unit, rows = None, []

    def pairs() -> pa.RecordBatch:
        label, side, n = (np.array([r[i] for r in rows]) for i in range(3))
        by = np.argsort(label, kind="stable")
        label, side, n = label[by], side[by], n[by]
        parts = np.frombuffer(b"".join(rows[i][3] for i in by.tolist()), np.uint16).reshape(len(rows), -1)
        least, found = int(np.ceil(agree * parts.shape[1])), []
        both = unit[1] == 0 or unit[2] != unit[3]  # a pair has one of each side
        after, group = np.searchsorted(label, label, "right"), label.copy()
        for i in range(len(label)):
            # groups that have met need no further pair: their cluster is compared on full sets
            fits = (group[after[i] :] != group[i]) & (100 * np.minimum(n[after[i] :], n[i]) >= min(AGREE) * np.maximum(n[after[i] :], n[i]))
            to = after[i] + np.flatnonzero(fits & (side[after[i] :] != side[i]) if both else fits)
            if len(to):
                for k in to[np.count_nonzero(parts[to] == parts[i], axis=1) >= least].tolist():
                    if group[k] != group[i]:
                        found.append((int(label[i]), int(label[k])))
                        group[group == group[k]] = group[i]
        return _edges(sorted(found))

    for batch in slices(batches, 1024):
        for *key, label, side, n, blob in zip(*(batch[k].to_pylist() for k in ("key", "kind", "x", "y", "label", "side", "n", "parts")), strict=True):
            if key != unit:
                if len(rows) > 1 and (out := pairs()).num_rows:
                    yield out
                unit, rows = key, []
            rows.append((label, side, n, blob))
    if len(rows) > 1 and (out := pairs()).num_rows:
        yield out


def candidates(open_: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """a, b: edges that connect linked groups which share a bucket and may hold a link. ``open_``: key, cid, label, n of buckets that aren't done.

    A bucket's largest linked group is side by side with the rest only, and the rest with itself, in parts of about MEET: rows grow with the
    buckets' members, times the parts of their rest.
    """
    groups = open_.groupBy("key", "label").agg(F.count("*").alias("docs"))
    top = groups.groupBy("key").agg(F.max(F.struct("docs", "label")).alias("t"), F.sum("docs").alias("docs"))
    parts = lambda docs: F.greatest(F.lit(1), F.ceil(docs / MEET)).cast("int")
    top = top.select("key", F.col("t.label").alias("top"), parts(F.col("t.docs")).alias("p"), parts(F.col("docs") - F.col("t.docs")).alias("q"))
    dealt = open_.join(top, "key").withColumn("inside", F.col("label") == F.col("top"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cid"), F.when(F.col("inside"), F.col("p")).otherwise(F.col("q"))).cast("int"))
    upto = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    unit = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.cast("int").alias("side"))
    with_rest = F.transform(upto("q"), lambda j: unit(0, F.col("own"), j, F.lit(0)))
    with_group = F.transform(upto("p"), lambda i: unit(0, i, F.col("own"), F.lit(1)))
    in_rest = F.transform(upto("q"), lambda j: unit(1, F.least("own", j), F.greatest("own", j), F.when(F.col("own") <= j, 0).otherwise(1)))
    units = dealt.select("key", "cid", "label", "n", F.explode(F.when(F.col("inside"), with_rest).otherwise(F.concat(with_group, in_rest))).alias("u"))
    rows = units.select("key", "u.*", "cid", "label", "n").join(members.select("cid", "parts"), "cid")
    order = ("key", "kind", "x", "y")
    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(lean(partial(_meet, agree=AGREE[percent])), "a long, b long").distinct()


def cluster_units(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """cluster, side, x, y, doc_id, shingles. ``clusters``: node, cluster, label (linked group), n (shingles)."""
    groups = clusters.groupBy("cluster", "label").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    top = groups.groupBy("cluster").agg(F.max(F.struct("docs", "label", "n")).alias("t"), F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    blocks = lambda docs, n: F.greatest(F.lit(1), F.ceil(docs / BLOCK_DOCS), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    top = Stored(top.select("cluster", F.col("t.label").alias("top"), blocks(F.col("t.docs"), F.col("t.n")).alias("p"), blocks(F.col("docs") - F.col("t.docs"), F.col("n") - F.col("t.n")).alias("q"))).df
    of_group = clusters.join(top, "cluster").withColumn("inside", F.col("label") == F.col("top"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("p")).otherwise(F.col("q"))).cast("int")
    upto = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    # side 0: x is a block of the group, y one of the rest; side 1: both of the rest
    with_rest = F.transform(upto("q"), lambda j: F.struct(F.lit(0).alias("side"), F.col("own").alias("x"), j.alias("y")))
    with_group = F.transform(upto("p"), lambda i: F.struct(F.lit(0).alias("side"), i.alias("x"), F.col("own").alias("y")))
    in_rest = F.transform(upto("q"), lambda j: F.struct(F.lit(1).alias("side"), F.least("own", j).alias("x"), F.greatest("own", j).alias("y")))
    unit = F.when(F.col("inside"), with_rest).otherwise(F.concat(with_group, in_rest))
    units = of_group.withColumn("own", own).select("cluster", F.col("node").alias("doc_id"), F.explode(unit).alias("u")).select("cluster", "u.*", "doc_id")
    return units.join(sets, "doc_id").select("cluster", "side", "x", "y", "doc_id", "shingles")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each document. Links hold from a similarity of ``percent`` (a key of ``BANDS``)."""
    docs = documents_of(docs)
    signed = Stored(docs.mapInArrow(lean(partial(_sign, bands=BANDS[percent])), SIGNED))
    usable = signed.df.where("hi is not null and doc_id is not null")
    first = usable.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "parts")).alias("r"))
    # numbered as they are written, so a class has one number for good
    classes = Stored(first.select(F.monotonically_increasing_id().alias("cid"), "hi", "lo", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n"), F.col("r.bands").alias("bands"), F.col("r.parts").alias("parts")))
    keys = classes.df.select("cid", F.explode("bands").alias("key"))
    # the smallest class of every bucket of two or more; grouped partially before the shuffle
    centre = keys.groupBy("key").agg(F.min("cid").alias("centre"), F.max("cid").alias("most")).where("centre < most").drop("most")
    # every class of such a bucket; one that is the smallest of all its buckets has no centre, whether or not it is a centre itself
    stars = Stored(keys.join(centre, "key").groupBy("cid").agg(F.min(F.when(F.col("cid") != F.col("centre"), F.col("centre"))).alias("centre")))
    members = Stored(classes.df.join(stars.df, "cid", "left_semi"))
    sets = Stored(sets_of(docs, members.df.select(F.col("cid").alias("doc_id"), "hi", "lo", "rep")))
    edges = Stored(star_links(stars.df.where("centre is not null").select(F.col("cid").alias("doc_id"), "centre"), sets.df, percent))
    labels = components(edges.df)
    labelled = Stored(members.df.join(labels, F.col("cid") == F.col("node"), "left").select("cid", "n", "bands", F.coalesce("comp", "cid").alias("label")))
    held = labelled.df.select("cid", "label", "n", F.explode("bands").alias("key"))
    not_done = held.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    open_ = Stored(held.join(not_done, "key"))
    maybe = Stored(candidates(open_.df, members.df, percent))
    if not maybe.df.isEmpty():
        # a linked group is one node here, however many classes it has
        met = components(maybe.df)
        clusters = Stored(open_.df.select("cid", "label", "n").distinct().join(met, F.col("label") == F.col("node")).select(F.col("cid").alias("node"), F.col("comp").alias("cluster"), "label", "n"))
        units = cluster_units(clusters.df, sets.df)
        found = units.repartition("cluster", "side", "x", "y").sortWithinPartitions("cluster", "side", "x", "y", "doc_id").mapInArrow(lean(partial(_compare, percent=percent)), "a long, b long")
        label_of = lambda end: labelled.df.select(F.col("cid").alias(end), F.col("label").alias(f"label_{end}"))
        more = Stored(found.join(label_of("a"), "a").join(label_of("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).where("a <> b").distinct())
        joined = components(more.df).select(F.col("node").alias("label"), "comp")
        labels = Stored(labelled.df.join(joined, "label", "left").select(F.col("cid").alias("node"), F.coalesce("comp", "label").alias("comp"))).df
        for t in (clusters, more):
            t.drop()
    grouped = classes.df.join(labels, F.col("cid") == F.col("node"), "left").select("hi", "lo", "rep", F.coalesce("comp", "cid").alias("comp"))
    least = grouped.groupBy("comp").agg(F.min("rep").alias("component"))
    of_set = Stored(grouped.join(least, "comp").select("hi", "lo", "component")).df
    for t in (maybe, open_, labelled, sets, members, edges, stars, classes):
        t.drop()
    whole = signed.df.select("doc_id", "n_shingles", "hi", "lo").withColumn("hi", F.when(F.col("doc_id").isNotNull(), F.col("hi"))).join(of_set, ["hi", "lo"], "left")
    component = F.coalesce("component", "doc_id")
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
