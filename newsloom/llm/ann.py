"""Approximate nearest neighbours: an NN-descent graph, built by Spark joins, and greedy graph search on it.

Graph: every vector gets DEGREE neighbours. The first ones come from blocks of consecutive rows under a few random
orderings (sign codes of random hyperplanes, then a projection), so blocks have a fixed size whatever the data. Then
each round joins neighbours of neighbours: a vector's neighbours and a bounded sample of those that name it as theirs
meet in one row group, pairs with a new member are measured, and what improves a list goes to its owner. Rounds end
when few lists change. Distances here are on vectors rounded to 32 bits, in double precision, whatever the size of other
vectors; they only steer the graph.

Search: a query starts at its own row's neighbours and keeps the BEAM nearest rows seen. Each round expands the
nearest unexpanded ones of its beam by a join with the graph, until all of the beam is expanded. Distances here are
exact, in double precision on the original vectors.

Every row is indexed; nothing is fitted on a sample. Groups are bounded: DEGREE + REVERSE rows for a vector, BEAM plus
EXPAND * (DEGREE + REVERSE) for a query. A vector that very many others name is a hot key of plain joins only.

Defined cases: rows with a null id, or a vector that is null, empty, zero, or holds nulls or non-finite values take no
part; nor do vectors of another length than the most frequent (the longer of equals), to which no distance exists: as queries
they return nothing; rows of one id count once (the smallest vector); with fewer than ``k`` other rows all are returned; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm._shared import Stored, lean

DEGREE, REVERSE, TREES, BLOCK, MAX_ROUNDS, FEW = 24, 20, 4, 100, 7, 0.01
BEAM, EXPAND = 448, 112
#: Components beyond this are cut to it for the graph: their squares still fit.
LARGEST = 1e30
BEST = 6  # finds of one vector in one group


def usable(rows: DataFrame, key: str, column: str) -> DataFrame:
    """id long, vec array<double>: one row for each id that takes part."""
    d = rows.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    d = d.where(fine).withColumn("n", F.size("vec"))
    # one row: the most frequent length
    size = d.groupBy("n").count().agg(F.max(F.struct("count", "n"))["n"].alias("n"))
    return d.join(F.broadcast(size), "n").groupBy("id").agg(F.min("vec").alias("vec"))


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """Equal-length binaries as a matrix."""
    column = column.cast(pa.large_binary())
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(dtype).reshape(n, -1)


def _lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _encode(planes: np.ndarray):
    """id, exact bytes, 32-bit bytes, and for each ordering a sign code and a projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _lists(batch["vec"])
            exact = [v.tobytes() for v in x]
            x = x.clip(-LARGEST, LARGEST)
            single = [v.tobytes() for v in x.astype(np.float32)]
            codes, along = [], []
            for p in planes:  # (bits + 1, dimensions)
                y = x @ p.T
                codes.append(((y[:, :-1] > 0) << np.arange(p.shape[0] - 1)).sum(1))
                along.append(y[:, -1])
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(exact, pa.binary()), pa.array(single, pa.binary()), pa.array(list(np.stack(codes, 1).astype(np.int64)), pa.list_(pa.int64())), pa.array(list(np.stack(along, 1)), pa.list_(pa.float64()))],
                names=["id", "exact", "single", "code", "along"],
            )

    return run


EDGES = "u long, v long, d double, fresh boolean"


def _edges(u, v, d, fresh) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float64()), pa.array(fresh, pa.bool_())], names=["u", "v", "d", "fresh"])


def _squared(x: np.ndarray) -> np.ndarray:
    """Squared distances within each of a stack of matrices."""
    n = np.einsum("...ij,...ij->...i", x, x)
    return np.maximum(n[..., :, None] + n[..., None, :] - 2 * (x @ np.swapaxes(x, -1, -2)), 0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in: the nearest of each row within its block of consecutive rows."""
    ids, vecs = np.zeros(0, np.int64), None

    def near(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        d = _squared(x.astype(np.float64))
        np.fill_diagonal(d, np.inf)
        k = min(DEGREE, len(ids) - 1)
        best = np.argpartition(d, k - 1, 1)[:, :k]
        return _edges(np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(d, best, 1).ravel(), np.ones(len(ids) * k, bool))

    for batch in batches:
        if batch.num_rows:
            ids = np.r_[ids, batch["id"].to_numpy()]
            more = _matrix(batch["single"], np.float32)
            vecs = more if vecs is None else np.concatenate([vecs, more])
            while len(ids) >= 2 * BLOCK:  # the last block of a partition takes what is left
                yield near(ids[:BLOCK], vecs[:BLOCK])
                ids, vecs = ids[BLOCK:], vecs[BLOCK:]
    if len(ids) > 1:
        yield near(ids, vecs)


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges sorted by (u, d, v, fresh) in: the DEGREE nearest distinct ones of each u. An edge known before stays old."""
    last_u, have, last_v = None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        u, v = batch["u"].to_numpy(), batch["v"].to_numpy()
        new_u = np.r_[last_u is None or u[0] != last_u, u[1:] != u[:-1]]
        distinct = new_u | np.r_[last_v is None or v[0] != last_v, v[1:] != v[:-1]]
        count = np.cumsum(distinct)
        start = np.flatnonzero(new_u)
        base = np.zeros(len(u), np.int64)
        base[start] = count[start] - 1
        np.maximum.accumulate(base, out=base)
        rank = count - base
        if not new_u[0]:
            rank[: start[0] if len(start) else len(u)] += have
        keep = distinct & (rank <= DEGREE)
        last_u, last_v, have = u[-1], v[-1], int(rank[-1])
        if keep.any():
            yield batch.filter(pa.array(keep))


def _join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by owner w: members x with vector, freshness and the largest distance in x's list. Improvements go out."""
    held: pa.RecordBatch | None = None

    def groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        w, x = batch["w"].to_numpy(), batch["x"].to_numpy()
        fresh = batch["fresh"].to_numpy(zero_copy_only=False)
        worst, vec = batch["worst"].to_numpy(), _matrix(batch["single"], np.float32)
        cut = _runs(w)
        top = int(np.diff(cut).max())
        for a in range(0, len(cut) - 1, 256):
            part = cut[a : a + 257]
            size = np.diff(part)
            at = part[:-1, None] + np.minimum(np.arange(top), size[:, None] - 1)
            here = np.arange(top) < size[:, None]
            d = _squared(vec[at].astype(np.float64))
            new = fresh[at] & here
            good = here[:, :, None] & here[:, None, :] & (new[:, :, None] | new[:, None, :]) & (x[at][:, :, None] != x[at][:, None, :]) & (d < worst[at][:, :, None])
            d = np.where(good, d, np.inf)
            if top > BEST:
                best = np.argpartition(d, BEST - 1, 2)[:, :, :BEST]
                d = np.take_along_axis(d, best, 2)
            else:
                best = np.broadcast_to(np.arange(top), d.shape)
            g, i, j = np.nonzero(np.isfinite(d))
            if len(g):
                yield _edges(x[at[g, i]], x[at[g, best[g, i, j]]], d[g, i, j], np.ones(len(g), bool))

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        w = batch["w"].to_numpy()
        last = int(np.searchsorted(w, w[-1]))
        held = batch.slice(last)
        if last:
            yield from groups(batch.slice(0, last))
    if held is not None:
        yield from groups(held)


def _reverse(edges: DataFrame, salt: int) -> DataFrame:
    """A bounded sample of the rows that name w: one for each of REVERSE bins, grouped partially before the shuffle."""
    binned = edges.groupBy(F.col("v").alias("w"), F.pmod(F.xxhash64("u", F.lit(salt)), F.lit(REVERSE)).alias("bin"))
    return binned.agg(F.min(F.struct((~F.col("fresh")).alias("old"), F.xxhash64("u").alias("h"), "u")).alias("m")).select("w", F.col("m.u").alias("x"), (~F.col("m.old")).alias("fresh"))


def _lists_of(edges: DataFrame) -> DataFrame:
    return edges.repartition("u").sortWithinPartitions("u", "d", "v", "fresh").mapInArrow(lean(_nearest), EDGES)


class Graph:
    def __init__(self, vectors: Stored, edges: Stored | None, rows: int):
        self.vectors, self.edges, self.rows = vectors, edges, rows


def build(rows: DataFrame, key: str = "vec_id", column: str = "embedding", seed: int = 4) -> Graph | None:
    """The graph over all usable rows; None if there are none."""
    raw = Stored(usable(rows, key, column))
    n, size = raw.df.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return None
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(np.log2(max(2, n / BLOCK))))
    planes = rng.normal(size=(TREES, min(bits, 60) + 1, size))
    vectors = Stored(raw.df.mapInArrow(lean(_encode(planes)), "id long, exact binary, single binary, code array<long>, along array<double>"))
    raw.drop()
    if n == 1:
        return Graph(vectors, None, n)
    first = None
    for t in range(TREES):
        order = vectors.df.select("id", "single", F.col("code")[t].alias("c"), F.col("along")[t].alias("a"))
        parts = max(1, n // (40 * BLOCK))
        order = order.repartitionByRange(parts, "c", "a", "id").sortWithinPartitions("c", "a", "id") if parts > 1 else order.coalesce(1).sortWithinPartitions("c", "a", "id")
        block = order.select("id", "single").mapInArrow(lean(_blocks), EDGES)
        first = block if first is None else first.unionByName(block)
    edges = Stored(_lists_of(first))
    for turn in range(MAX_ROUNDS):
        e = edges.df
        members = e.select(F.col("u").alias("w"), F.col("v").alias("x"), "fresh").unionByName(_reverse(e, turn)).groupBy("w", "x").agg(F.max("fresh").alias("fresh"))
        ends = e.groupBy("u").agg(F.when(F.count("*") >= DEGREE, F.max("d")).otherwise(F.lit(float("inf"))).alias("worst"))
        known = Stored(vectors.df.select("id", "single").join(ends, F.col("id") == F.col("u")).select(F.col("id").alias("x"), "single", "worst"))
        groups = members.join(known.df, "x").repartition("w").sortWithinPartitions("w")
        found = groups.select("w", "x", "fresh", "single", "worst").mapInArrow(lean(_join_groups), EDGES)
        new = Stored(_lists_of(e.withColumn("fresh", F.lit(False)).unionByName(found)))
        changed = new.df.where("fresh").count()
        edges.drop()
        known.drop()
        edges = new
        if changed < FEW * n * DEGREE:
            break
    both = edges.df.select("u", "v").unionByName(_reverse(edges.df, -1).select(F.col("w").alias("u"), F.col("x").alias("v"))).distinct()
    graph = Graph(vectors, Stored(both), n)
    edges.drop()
    return graph


BEAMS = "q long, qvec binary, ids array<long>, ds array<double>, done array<boolean>"


def _beams(beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by (q, kind): a query's beam, then its candidates with their vectors; the new beam goes out."""
        q, vec, ids, ds, done = None, None, None, None, None
        out: list[tuple] = []

        def add(new: np.ndarray, x: np.ndarray) -> None:
            nonlocal ids, ds, done
            d = np.sqrt(((x - vec) ** 2).sum(1))
            ids, ds, done = np.r_[ids, new], np.r_[ds, d], np.r_[done, np.zeros(len(new), bool)]
            _, first = np.unique(ids, return_index=True)  # the first of equals is the one known before
            order = first[np.lexsort((ids[first], ds[first]))][:beam]
            ids, ds, done = ids[order], ds[order], done[order]

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["q", "qvec", "ids", "ds", "done"])

        for batch in batches:
            if not batch.num_rows:
                continue
            qs, kind = batch["q"].to_numpy(), batch["kind"].to_numpy()
            cut = np.flatnonzero(np.r_[True, (qs[1:] != qs[:-1]) | (kind[1:] != kind[:-1]), True])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if kind[a] == 0:
                    if q is not None:
                        out.append((q, vec.tobytes(), ids, ds, done))
                    q, vec = int(qs[a]), np.frombuffer(batch["qvec"][a].as_py(), np.float64)
                    ids, ds, done = (np.array(batch[k][a].as_py(), t) for k, t in (("ids", np.int64), ("ds", np.float64), ("done", bool)))
                else:
                    part = batch.slice(a, b - a)
                    add(part["x"].to_numpy(), _matrix(part["exact"], np.float64))
            if len(out) >= 500:
                yield flush()
        if q is not None:
            out.append((q, vec.tobytes(), ids, ds, done))
        if out:
            yield flush()

    return run


def search(graph: Graph | None, queries: DataFrame, k: int = 10, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each of the indexed rows whose id is in ``queries`` (column id)."""
    spark = queries.sparkSession
    if graph is None or graph.edges is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = graph.vectors.df.select("id", "exact")
    empty = "cast(array() as array<{}>)".format
    start = v.join(queries.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
    beams = Stored(start.select(F.col("id").alias("q"), F.col("exact").alias("qvec"), F.expr(empty("long")).alias("ids"), F.expr(empty("double")).alias("ds"), F.expr(empty("boolean")).alias("done")))
    at = beams.df.select("q", F.col("q").alias("u"))
    while True:
        ask = at.join(graph.edges.df, "u").where("v <> q").select("q", F.col("v").alias("id")).distinct()
        found = ask.join(v, "id").select("q", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("qvec"), F.expr("cast(null as array<long>)").alias("ids"), F.expr("cast(null as array<double>)").alias("ds"), F.expr("cast(null as array<boolean>)").alias("done"), F.col("id").alias("x"), "exact")
        state = beams.df.withColumn("going", _next(expand)).withColumn("done", F.transform("ids", lambda x, i: F.get("done", i) | F.array_contains("going", x)))
        state = state.select("q", F.lit(0).alias("kind"), "qvec", "ids", "ds", "done", F.lit(None).cast("long").alias("x"), F.lit(None).cast("binary").alias("exact"))
        new = Stored(state.unionByName(found).repartition("q").sortWithinPartitions("q", "kind").mapInArrow(lean(_beams(beam)), BEAMS))
        beams.drop()
        beams = new
        at = beams.df.select("q", F.explode(_next(expand)).alias("u"))
        if at.isEmpty():
            break
    top = beams.df.select("q", F.posexplode(F.slice(F.arrays_zip("ids", "ds"), 1, k)).alias("i", "r"))
    return top.select(F.col("q").alias("query_id"), (F.col("i") + 1).cast("int").alias("rank"), F.col("r.ids").alias("vec_id"), F.col("r.ds").alias("score"))


def _next(expand: int):
    """The nearest rows of the beam that aren't expanded yet; null when the beam is new."""
    return F.slice(F.transform(F.filter(F.arrays_zip("ids", "done"), lambda s: ~s["done"]), lambda s: s["ids"]), 1, expand)


def nearest(rows: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Indexes all rows and searches those whose id is divisible by ``every``."""
    graph = build(rows, key, column)
    ids = rows.select(F.col(key).cast("long").alias("id")).where(F.col("id") % every == 0)
    return search(graph, ids, k)
