"""Near-duplicate embeddings by an epsilon grid order join: every link of a cosine of ``COSINE`` or more, exactly.

Vectors of that cosine lie within ``EPSILON`` of each other at unit length. Leading principal axes come from the covariance of all
vectors; a vector's grid cells along them (side ``EPSILON``, then an eighth of it) and its id are its place in the order. Ranges of
the order are packed to blocks, neighbouring blocks to tiles, and tiles to a tree of intervals with FAN children each.

* The join starts with the interval of all against itself. A pair of intervals that is provably distant (by the boxes of its
  cells' coordinates, or by balls around the means) goes; a pair of which all vectors are provably near is done as a whole: it adds the
  other's size to each vector's links, so copies by the million cost no comparisons. Any other pair becomes the pairs of its children.
  Each level is one join of interval summaries.
* Pairs of tiles that are left are units of work: two tiles at most are held. Inside, sub-blocks of ``PART`` rows are skipped or taken
  whole by the same bounds; the others are multiplied in 32 bits, and sub-blocks where a product comes near the bound again in double precision
  on the vectors as given (scaled by powers of two, which changes no cosine).
* A unit returns one row for each vector that has links in it: their number and one vector of its group there. Sums are the links,
  connected groups the components. No pair of vectors is ever a row.

On data without structure (independent directions in many dimensions) nothing is provably distant, and the work of this method is quadratic with
the constant of a matrix product; rows and shuffled bytes grow with the pairs of tiles.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null id, link with nothing and
are kept; vectors link only with vectors of the same length; each of several rows of one id is a vector; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm._shared import Stored, lean
from newsloom.llm.graph import components

COSINE = 0.9
EPSILON = (2 - 2 * COSINE) ** 0.5
#: Leading axes of the grid; components that enter the covariance at most.
AXES, COVARIED = 8, 256
#: Bytes of a block's vectors, and rows of a sub-block.
BLOCK_BYTES, PART = 2 << 20, 256
#: Children of an interval, as bits.
FAN_BITS = 3
#: Rounding of bounds: nothing within it counts as proved.
SLACK = 1e-6
BLOCK = "pid int, idx int, n int, size long, ids binary, vecs binary, lo array<double>, hi array<double>, centre array<double>, radius double"
NODE = "id long, first long, n_lo int, n_hi int, size long, lo array<double>, hi array<double>, centre array<double>, radius double"


def usable(rows: DataFrame, key: str, column: str) -> DataFrame:
    """vec_id, vec (array of double), and whether the vector takes part."""
    d = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return d.withColumn("usable", F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a column of arrays, without copies."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by powers of two, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(size: int):
    """Sums of products, then of components, then the number of vectors of this length: (place, sum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = min(size, COVARIED)
        sums = np.zeros(a * a + a + 1)
        for batch in batches:
            rows = [v for v in _lists(batch["vec"]) if len(v) == size]
            for at in range(0, len(rows), 4096):
                x = unit(np.array(rows[at : at + 4096], np.float64))[:, :a]
                sums += np.r_[(x.T @ x).ravel(), x.sum(0), len(x)]
        if sums[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int64()), pa.array(sums)], names=["place", "sum"])

    return run


def axes_of(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """The most frequent length, and the leading principal axes (columns) of the vectors of that length."""
    best = vectors.groupBy(F.size("vec").alias("n")).count().agg(F.max(F.struct("count", "n"))["n"].alias("n")).first()
    size = best.n if best and best.n else 1
    # COVARIED squared and so many rows at most
    rows = vectors.select("vec").mapInArrow(lean(_moments(size)), "place long, sum double").groupBy("place").agg(F.sum("sum").alias("sum")).collect()
    a = min(size, COVARIED)
    sums = np.zeros(a * a + a + 1)
    for r in rows:
        sums[r.place] = r["sum"]
    n = max(sums[-1], 1)
    mean = sums[a * a : -1] / n
    _, vectors_ = np.linalg.eigh(sums[: a * a].reshape(a, a) / n - np.outer(mean, mean))
    return size, vectors_[:, ::-1][:, :AXES].copy()


def projected(u: np.ndarray, size: int, axes: np.ndarray) -> np.ndarray:
    """Coordinates along AXES orthogonal directions: the principal ones, or the first components of vectors of another length."""
    p = u[:, : len(axes)] @ axes if u.shape[1] == size else u[:, :AXES]
    return np.pad(p, ((0, 0), (0, AXES - p.shape[1])))


def _by_length(rows: list[np.ndarray]) -> Iterator[np.ndarray]:
    n = np.array([len(v) for v in rows])
    for k in np.unique(n):
        for at in range(0, len(rows), 4096):
            if len(some := at + np.flatnonzero(n[at : at + 4096] == k)):
                yield some


def _encode(size: int, axes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch["vec_id"].to_numpy(), _lists(batch["vec"])
            for some in _by_length(rows):
                x = np.array([rows[i] for i in some], np.float64)
                p = projected(unit(x), size, axes)
                cells = np.hstack([np.floor(p / EPSILON), np.floor(p * 8 / EPSILON)]).astype(np.int64) + 128
                keys = [k.tobytes() for k in cells.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array([x.shape[1]] * len(x), pa.int32()), pa.array(keys, pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "n", "key", "vec"])

    return run


def _ball(u: np.ndarray) -> tuple[np.ndarray, float]:
    centre = u.mean(axis=0)
    return centre, float(np.sqrt(np.square(u - centre).sum(axis=1).max()))


def _pack(size: int, axes: np.ndarray):
    """Rows sorted by length, cells and id to blocks of one length."""

    def block(pid: int, idx: int, ids: list[int], vecs: list[bytes]) -> dict:
        x = np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)
        u = unit(x)
        p, (centre, radius) = projected(u, size, axes), _ball(u)
        single = x.astype(np.float32, casting="same_kind")
        blob = single.tobytes() if np.array_equal(single.astype(np.float64), x) else x.tobytes()
        return {"pid": pid, "idx": idx, "n": x.shape[1], "size": len(x), "ids": np.array(ids, np.int64).tobytes(), "vecs": blob, "lo": p.min(0), "hi": p.max(0), "centre": centre, "radius": radius}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.float64())
        schema = pa.schema([("pid", pa.int32()), ("idx", pa.int32()), ("n", pa.int32()), ("size", pa.int64()), ("ids", pa.binary()), ("vecs", pa.binary()), ("lo", lists), ("hi", lists), ("centre", lists), ("radius", pa.float64())])
        pid, idx, ids, vecs = TaskContext.get().partitionId(), 0, [], []
        with np.errstate(over="ignore"):
            for batch in batches:
                for i, v in zip(batch["vec_id"].to_pylist(), batch["vec"].to_pylist(), strict=True):
                    if vecs and (len(v) != len(vecs[0]) or len(v) * len(vecs) >= BLOCK_BYTES):
                        yield pa.RecordBatch.from_pylist([block(pid, idx, ids, vecs)], schema)
                        idx, ids, vecs = idx + 1, [], []
                    ids.append(i)
                    vecs.append(v)
            if vecs:
                yield pa.RecordBatch.from_pylist([block(pid, idx, ids, vecs)], schema)

    return run


# --- the tree of intervals ------------------------------------------------------------------------


def _summary(rows):
    """One interval from those that it holds (a few)."""
    import pandas as pd

    n_lo, n_hi, sizes = rows["n_lo"].min(), rows["n_hi"].max(), rows["size"].to_numpy()
    lo, hi = np.stack(rows["lo"]).min(0), np.stack(rows["hi"]).max(0)
    centre, radius = np.zeros(0), np.inf
    if n_lo == n_hi and np.isfinite(rows["radius"]).all():
        c = np.stack(rows["centre"])
        centre = sizes @ c / sizes.sum()
        radius = float((np.linalg.norm(c - centre, axis=1) + rows["radius"].to_numpy()).max())
    return pd.DataFrame({"id": [rows["id"].iloc[0]], "first": [rows["first"].min()], "n_lo": [n_lo], "n_hi": [n_hi], "size": [sizes.sum()], "lo": [lo], "hi": [hi], "centre": [centre], "radius": [radius]})


def parents(nodes: DataFrame, bits: int = FAN_BITS) -> DataFrame:
    return nodes.withColumn("id", F.shiftright("id", bits)).groupBy("id").applyInPandas(_summary, NODE)


FAR, NEAR, OPEN = 0, 1, 2


def relation(box_a, box_b, ball_a, ball_b) -> int:
    """Whether all vectors of two intervals of one length are farther apart than EPSILON, all nearer, or neither is proved."""
    gap = np.maximum(0, np.maximum(box_a[0] - box_b[1], box_b[0] - box_a[1]))
    if np.sqrt(gap @ gap) > EPSILON + SLACK:
        return FAR
    between, around = float(np.linalg.norm(ball_a[0] - ball_b[0])), ball_a[1] + ball_b[1]
    return FAR if between - around > EPSILON + SLACK else NEAR if between + around < EPSILON - SLACK else OPEN


def _relate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fates = []
        for r in batch.to_pylist():
            x, y = r["x"], r["y"]
            if x["n_lo"] > y["n_hi"] or y["n_lo"] > x["n_hi"]:
                fates.append(FAR)
            elif x["n_lo"] != x["n_hi"] or y["n_lo"] != y["n_hi"]:
                fates.append(OPEN)
            else:
                box, ball = (lambda s: (np.array(s["lo"]), np.array(s["hi"]))), (lambda s: (np.array(s["centre"]), s["radius"]))
                fates.append(relation(box(x), box(y), ball(x), ball(y)))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(fates, pa.int32())], names=["a", "b", "fate"])


def interval_pairs(levels: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Pairs of tiles that must be compared (a, b), and wholes: (level, node, add, anchor), where every vector of a node gains ``add``
    links, and all of them are linked with the block ``anchor``."""
    spark = levels[0].sparkSession
    pairs, wholes = spark.createDataFrame([(0, 0)], "a long, b long"), []
    for level in range(len(levels) - 1, -1, -1):
        nodes = levels[level]
        side = lambda key, name: nodes.select(F.col("id").alias(key), F.struct(*[c for c in nodes.columns if c != "id"]).alias(name))  # noqa: B023, E731
        known = Stored(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(lean(_relate), "a long, b long, fate int")).df
        at = nodes.select(F.col("id"), F.col("size"), F.col("first"))
        near = known.where(f"fate = {NEAR}").join(at.withColumnsRenamed({"id": "a", "size": "size_a"}), "a").join(at.withColumnsRenamed({"id": "b", "size": "size_b"}).drop("first"), "b")
        wholes.append(near.select(F.lit(level).alias("level"), F.col("a").alias("node"), F.when(F.col("a") == F.col("b"), F.col("size_b") - 1).otherwise(F.col("size_b")).alias("add"), F.col("first").alias("anchor")))
        wholes.append(near.where("a <> b").select(F.lit(level).alias("level"), F.col("b").alias("node"), F.col("size_a").alias("add"), F.col("first").alias("anchor")))
        pairs = known.where(f"fate = {OPEN}").select("a", "b")
        if level:
            child = levels[level - 1].select(F.shiftright("id", FAN_BITS).alias("parent"), F.col("id").alias("child"))
            of = lambda key, name: child.withColumnsRenamed({"parent": key, "child": name})  # noqa: B023, E731
            pairs = pairs.join(of("a", "ca"), "a").join(of("b", "cb"), "b").where("a <> b or ca <= cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    whole = wholes[0]
    for w in wholes[1:]:
        whole = whole.unionByName(w)
    return pairs, Stored(whole).df


# --- comparing ----------------------------------------------------------------------------------


class Unit:
    """The vectors of one or two tiles: links of each, and a forest of the groups that they form here."""

    def __init__(self, size: int, axes: np.ndarray):
        self.size, self.axes = size, axes
        self.rids: list[np.ndarray] = []
        self.parts: list[tuple] = []  # side, first row, vectors, unit vectors in 32 bits, norms, box, ball
        self.rows = 0

    def load(self, side: int, pos: int, size: int, n: int, blob: bytes) -> None:
        x = scaled(np.frombuffer(blob, np.float32 if len(blob) == 4 * n * size else np.float64).reshape(size, n).astype(np.float64))
        norm = np.linalg.norm(x, axis=1)
        u = x / norm[:, None]
        p = projected(u, self.size, self.axes)
        for at in range(0, size, PART):
            part = slice(at, at + PART)
            self.parts.append((side, self.rows + at, x[part], u[part].astype(np.float32), norm[part], (p[part].min(0), p[part].max(0)), _ball(u[part])))
        self.rids.append((pos << 20) + np.arange(size))
        self.rows += size

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def _whole(self, i: int, j: int) -> None:
        for k in {i, j} - self.united:
            first = self.parts[k][1]
            for row in range(first + 1, first + len(self.parts[k][2])):
                self.union(first, row)
            self.united.add(k)
        (_, a, x, *_), (_, b, y, *_) = self.parts[i], self.parts[j]
        self.union(a, b)
        self.links[a : a + len(x)] += len(y) - (i == j)
        if i != j:
            self.links[b : b + len(y)] += len(x)

    def _exact(self, i: int, j: int) -> None:
        (_, a, x, _, nx, *_), (_, b, y, _, ny, *_) = self.parts[i], self.parts[j]
        near = x @ y.T / (nx[:, None] * ny[None, :]) >= COSINE
        if i == j:
            near |= near.T
            np.fill_diagonal(near, False)
        rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(rows):
            return
        self.links[a : a + len(x)] += near.sum(1)
        if i != j:
            self.links[b : b + len(y)] += near.sum(0)
        near = near[np.ix_(rows, columns)]
        low, high = np.arange(len(rows)), np.full(len(columns), len(rows))
        while True:  # the smallest row that rows and columns reach
            high = np.minimum(high, np.where(near, low[:, None], len(rows)).min(0))
            new = np.minimum(low, np.where(near, high[None, :], len(rows)).min(1))
            if np.array_equal(new, low):
                break
            low = new
        for at, labels, first in ((rows, low, a), (columns, high, b)):
            for row, label in zip((first + at).tolist(), (a + rows[labels]).tolist(), strict=True):
                self.union(row, label)

    def compare(self) -> pa.RecordBatch | None:
        """(rid, links, other): one row for each vector that has links here."""
        self.root, self.links, self.united = list(range(self.rows)), np.zeros(self.rows, np.int64), set()
        two = self.parts[-1][0] != self.parts[0][0]
        for i, (side, _, x, u, _, box, ball) in enumerate(self.parts):
            if two and side:
                break
            todo = []
            for j in range(0 if two else i, len(self.parts)):
                other = self.parts[j]
                if two and other[0] == side or other[2].shape[1] != x.shape[1]:
                    continue
                found = relation(box, other[5], ball, other[6])
                if found == NEAR:
                    self._whole(i, j)
                elif found == OPEN:
                    todo.append(j)
            if todo:
                bound = np.float32(COSINE - (x.shape[1] + 8) * 6e-8)
                for at in range(0, len(todo), 16):
                    some = todo[at : at + 16]
                    most = (u @ np.concatenate([self.parts[j][3] for j in some]).T).max(axis=0)
                    ends = np.cumsum([len(self.parts[j][3]) for j in some])
                    if i in some:  # each vector is near itself
                        most[ends[some.index(i)] - len(u) : ends[some.index(i)]] = 1
                    for j in np.array(some)[np.unique(np.searchsorted(ends, np.flatnonzero(most >= bound), "right"))].tolist():
                        self._exact(i, j)
        rids = np.concatenate(self.rids)
        some = np.flatnonzero(self.links)
        if not len(some):
            return None
        roots = [self.find(i) for i in some.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(rids[some]), pa.array(self.links[some]), pa.array(rids[roots])], names=["rid", "links", "other"])


def _compare(size: int, axes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by unit and side come in; a unit is held at a time."""
        at, unit_ = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, side, pos, n, count, blob = (batch[c][k].as_py() for c in ("a", "b", "side", "pos", "n", "size", "vecs"))
                if (a, b) != at:
                    if unit_ and (out := unit_.compare()):
                        yield out
                    at, unit_ = (a, b), Unit(size, axes)
                unit_.load(side, pos, count, n, blob)
        if unit_ and (out := unit_.compare()):
            yield out

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tile, pos, ids in zip(*(batch[c].to_pylist() for c in ("tile", "pos", "ids")), strict=True):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((pos << 20) + np.arange(len(ids))), pa.array(np.full(len(ids), tile)), pa.array(ids)], names=["rid", "tile", "vec_id"])


def near_duplicates(rows: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row."""
    every = usable(rows, key, column)
    vectors = every.where("usable").select("vec_id", "vec")
    size, axes = axes_of(vectors)
    coded = vectors.mapInArrow(lean(_encode(size, axes)), "vec_id long, n int, key binary, vec binary")
    packed = Stored(coded.repartitionByRange("n", "key", "vec_id").sortWithinPartitions("n", "key", "vec_id").mapInArrow(lean(_pack(size, axes)), BLOCK)).df
    all_ = packed.agg(F.max("idx").alias("idx"), F.max("pid").alias("pid"), F.sum("size").alias("rows"), F.countDistinct("pid").alias("parts")).first()
    alone = every.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not all_.rows:
        return alone
    # partitions of less than a block are tiles together
    inner = int(all_.idx).bit_length()
    together = 0 if inner else max(0, int(BLOCK_BYTES / (8 * size) * all_.parts / all_.rows).bit_length() - 1)
    pos = F.shiftleft(F.col("pid").cast("long"), inner) + F.col("idx")
    blocks = packed.withColumn("pos", pos).withColumn("tile", F.shiftright("pos", together))
    leaf = blocks.select(F.col("tile").alias("id"), F.col("pos").alias("first"), F.col("n").alias("n_lo"), F.col("n").alias("n_hi"), "size", "lo", "hi", "centre", "radius")
    levels = [Stored(leaf.groupBy("id").applyInPandas(_summary, NODE)).df]
    top = (int(all_.pid) << inner | (1 << inner) - 1) >> together
    while top:
        levels.append(Stored(parents(levels[-1])).df)
        top >>= FAN_BITS
    pairs, wholes = interval_pairs(levels)
    pairs = Stored(pairs).df
    content = blocks.select("tile", "pos", "n", "size", "vecs")
    left = pairs.join(content, F.col("a") == F.col("tile")).withColumn("side", F.lit(0))
    right = pairs.where("a <> b").join(content, F.col("b") == F.col("tile")).withColumn("side", F.lit(1))
    units = left.unionByName(right).select("a", "b", "side", "pos", "n", "size", "vecs").repartition("a", "b").sortWithinPartitions("a", "b", "side", "pos")
    found = Stored(units.mapInArrow(lean(_compare(size, axes)), "rid long, links long, other long")).df
    members = blocks.select("tile", "pos", "ids").mapInArrow(lean(_members), "rid long, tile long, vec_id long")
    # what whole intervals add, tile by tile, and the groups that they join
    tiles = levels[0].select(F.col("id").alias("tile"), F.shiftleft("first", 20).alias("own"))
    gains = None
    for level in range(len(levels)):
        part = wholes.where(F.col("level") == level).join(tiles.withColumn("node", F.shiftright("tile", level * FAN_BITS)), "node").select("tile", "own", "add", F.shiftleft("anchor", 20).alias("other"))
        gains = part if gains is None else gains.unionByName(part)
    gains = Stored(gains).df
    gained = members.join(gains.groupBy("tile").agg(F.sum("add").alias("links"), F.min("own").alias("other")), "tile").select("rid", "links", "other")
    links = Stored(found.unionByName(gained)).df
    edges = links.select(F.col("rid").alias("a"), F.col("other").alias("b")).unionByName(gains.select(F.col("own").alias("a"), F.col("other").alias("b"))).where("a <> b").distinct()
    group = components(edges)
    sums = links.groupBy("rid").agg(F.sum("links").alias("n_links"))
    linked = Stored(members.join(sums, "rid", "left").join(group.withColumnRenamed("node", "rid"), "rid", "left").select("rid", "vec_id", "n_links", "comp")).df
    least = linked.where("comp is not null").groupBy("comp").agg(F.min("vec_id").alias("least"))
    out = linked.join(least, "comp", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")).unionByName(alone)
