"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted ``target / source size`` times (0 to 2). The whole part is taken; the
fraction is settled by the pivotal method in its word-weighted form: two undecided documents of a source trade
probability mass, at random and without bias, until one of them is wholly in or wholly out. A trade leaves the
sum of (fraction times words) as it was, so the words taken by a source differ from its target by less than one
document, the last undecided one. Trades run inside blocks of one source, large documents first; what stays undecided of a
block, one document, meets other blocks' of the source in a tree of reductions of bounded fan-in. Of every ``fan_in``
documents one (by hash) skips the trades of its block, so that each level up has documents of all sizes to trade with
and a node holds about as many rows as a block, however many sources there are.

Blocks and trades depend on ids and sizes only, not on how Spark partitions the input, so reruns agree.

Defined cases: a null text has size 0; a document of size 0 takes 0 words; a null source is a source of its own,
last in order; repeated rows (same id) are rows of their own; an empty table gives no rows; extra columns of any name are
kept by ``mixed`` and otherwise ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm._shared import Stored, columns_of, lean, mix, stored, unused

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Rows that a block settles, and blocks whose leftovers meet in one node of the tree.
BLOCK_ROWS, FAN_IN = 20_000, 64
SOURCES_A_RANGE = 100_000
EPS = 1e-9


def numbered(sources: DataFrame) -> DataFrame:
    """Rows with ``no``: their place in the order of source (null last), from 0. Ranges are sorted each for itself; only their sizes meet."""
    none = F.col("source").isNull()
    parts = max(1, -(-sources.count() // SOURCES_A_RANGE))
    placed = Stored(sources.repartitionByRange(parts, none, "source").sortWithinPartitions(none, "source").withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    before, offsets = 0, []
    for r in placed.df.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row for each range
        offsets.append((r["part"], before))
        before += r["count"]
    offset = sources.sparkSession.createDataFrame(offsets, "part long, before long")
    return placed.df.join(F.broadcast(offset), part == F.col("part")).withColumn("no", F.col("before") + F.col("__at") - F.shiftleft(part, 33)).drop("__at", "part", "before")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target, one row for each source. Filling to a common level: target = least(most * size, level * weight).

    The level rises from that of all sources open; those it fills are closed and give their excess to the others, until
    none is filled any more. Each turn is one sum over the sources.
    """
    per = numbered(Stored(sized.groupBy("source").agg(F.sum("__size").alias("source_size"))).df)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    per = Stored(per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))).df
    total = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        closed = F.col("cap") < F.lit(level) * F.col("weight") if full >= 0 else F.lit(False)
        n, caps, open_weight = per.agg(F.sum(closed.cast("long")), F.sum(F.when(closed, F.col("cap")).otherwise(0.0)), F.sum(F.when(closed, 0.0).otherwise(F.col("weight")))).first()
        if n is None or n == full or not open_weight:
            break
        full, level = n, (total - caps) / open_weight
    filled = F.col("cap") if n is None or not open_weight else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return per.select("source", "source_size", filled.alias("target"))


def _uniform(a: np.ndarray, level: int, seed: int) -> np.ndarray:
    h = mix(mix(a.astype(np.uint64) + np.uint64(seed)) + np.uint64(level))
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def settle(p: list[float], s: list[float], u: list[float]) -> tuple[list[int], int]:
    """One pass of trades over documents of one source: whole copies (0 or 1; -1: undecided) and the undecided index or -1.

    ``p`` is changed in place. Each trade holds p_i s_i + p_j s_j and keeps the mean of both.
    """
    out, held = [-1] * len(p), -1
    for j in range(len(p)):
        if p[j] < EPS or p[j] > 1 - EPS or s[j] <= 0:
            out[j] = int(p[j] > 0.5)
            continue
        if held < 0:
            held = j
            continue
        i = held
        up = min((1 - p[i]) * s[i], p[j] * s[j])  # words that i can take from j
        down = min(p[i] * s[i], (1 - p[j]) * s[j])
        d = up if u[j] * (up + down) < down else -down
        p[i] += d / s[i]
        p[j] -= d / s[j]
        held = -1
        for x in (i, j):
            if p[x] < EPS or p[x] > 1 - EPS:
                out[x] = int(p[x] > 0.5)
            else:
                held = x
    return out, held


def _settle_block(level: int, seed: int, reserve: int):
    def finished(batch: pa.RecordBatch, took: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        left = (took < 0) & (batch["__nodes"].to_numpy() == 1)
        if left.any():  # a root rounds what is left at random, by its own probability
            took = np.where(left, _uniform(batch["__order"].to_numpy(), level + 1000, seed) < p, took)
        columns = [pa.array(p) if k == "__p" else batch[k] for k in batch.schema.names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(took.astype(np.int64))], names=[*batch.schema.names, "__took"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (source, node, size). The last group of a batch may go on in the next: its undecided row is carried on."""
        carried: tuple[pa.RecordBatch, float] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            p = batch["__p"].to_numpy().copy()
            order = batch["__order"].to_numpy()
            trades = (batch["__nodes"].to_numpy() == 1) | (mix(order.astype(np.uint64) + np.uint64(level)) % np.uint64(reserve) != 0)
            if carried is not None:
                batch = pa.Table.from_batches([carried[0], batch]).combine_chunks().to_batches()[0]
                p, trades = np.r_[carried[1], p], np.r_[True, trades]
            node, source = batch["__node"].to_numpy(), batch["__source_no"].to_numpy()
            cut = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (source[1:] != source[:-1])]).tolist()
            s, u = batch["__size"].to_numpy().astype(float), _uniform(batch["__order"].to_numpy(), level, seed)
            took, at = np.full(batch.num_rows, -1), -1
            for a, b in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                rows = a + np.flatnonzero(trades[a:b])
                part = p[rows].tolist()
                took[rows], at = settle(part, s[rows].tolist(), u[rows].tolist())
                p[rows] = part
                at = int(rows[at]) if at >= 0 else -1
            carried = (batch.slice(at, 1), p[at]) if at >= 0 else None
            rest = np.delete(np.arange(batch.num_rows), [at] if at >= 0 else [])
            yield finished(batch.take(pa.array(rest)), took[rest], p[rest])
        if carried is not None:
            yield finished(carried[0], np.array([-1]), np.array([carried[1]]))

    return run


def copies(items: DataFrame, seed: int = 17, block_rows: int = BLOCK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """``items``: __key long, __source_no, __size long, __p double (fraction), and columns to carry. Adds __took (0 or 1).

    A source has as many blocks as its rows need; its tree ends where one node is left.
    """
    items = items.withColumn("__order", F.xxhash64("__key", "__size", F.lit(seed)))
    # whole fractions and empty documents need no trade
    fractional = F.col("__p").between(EPS, 1 - EPS) & (F.col("__size") > 0)
    done = items.where(~fractional).withColumn("__took", (F.col("__p") > 0.5).cast("long"))
    items = items.where(fractional)
    blocks = Stored(items.groupBy("__source_no").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("__nodes")))
    most = blocks.df.agg(F.max("__nodes")).first()[0] or 1
    items = items.join(blocks.df, "__source_no").withColumn("__node", F.pmod(F.xxhash64("__key", F.lit(seed + 1)), F.col("__nodes")))
    schema = T.StructType([*items.schema.fields, T.StructField("__took", T.LongType())])
    level = 0
    while True:
        # a block's rows meet large before small, so that what is left over is small
        run = items.repartition("__source_no", "__node").sortWithinPartitions("__source_no", "__node", F.col("__size").desc(), "__order").mapInArrow(lean(_settle_block(level, seed, fan_in)), schema)
        if most == 1:
            return done.unionByName(run.drop("__nodes", "__node"))
        run = stored(run)
        done = done.unionByName(run.where("__took >= 0").drop("__nodes", "__node"))
        most = -(-most // fan_in)
        items = run.where("__took < 0").drop("__took").withColumn("__nodes", F.ceil(F.col("__nodes") / fan_in).cast("long")).withColumn("__node", F.floor(F.col("__node") / fan_in))
        level += 1


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17, row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (and the column ``row``): one row for each row of ``docs``. Texts are only counted, not moved."""
    extra = [] if row is None else [F.col(row).alias("__row")]
    sized = stored(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("__size"), *extra))
    targets = stored(source_targets(sized, weights, share, most))
    numbered_ = targets.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.coalesce(F.xxhash64(F.struct("source")), F.lit(0)).alias("__source_no"))
    joined = sized.join(numbered_, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    wanted = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
    # the last 1e-12 of a whole number is rounding in the division
    joined = joined.withColumn("__want", wanted).withColumn("__whole", F.floor(F.col("__want") + 1e-12)).withColumn("__p", F.greatest(F.lit(0.0), F.col("__want") - F.col("__whole")))
    joined = joined.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)))
    out = copies(joined, seed).withColumn("__copies", (F.col("__whole") + F.col("__took")).cast("long"))
    out = out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"), (F.col("__copies") * F.col("__size")).alias("taken"), *([] if row is None else [F.col("__row").alias(row)]))
    return out


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it. Rows that are equal in every column share their copies evenly."""
    row, of_id, of_row, total, rows, copy = unused(docs, "row_hash", "of_id", "of_row", "total", "rows", "copy")
    hashable = [c for c, f in zip(columns_of(docs), docs.schema.fields, strict=True) if not isinstance(f.dataType, T.MapType | T.VariantType)]
    keyed = docs.withColumn(row, F.xxhash64(*hashable))
    decided = mix_documents(keyed, row=row, **options).groupBy("doc_id", row).agg(F.sum("copies").alias(total), F.count("*").alias(rows)).where(F.col(total) > 0)
    decided = stored(decided.withColumnsRenamed({"doc_id": of_id, row: of_row}))
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(row) == F.col(of_row))
    each = lambda df, n: df.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), n))).select(*columns_of(docs))
    even = F.floor(F.col(total) / F.col(rows))
    out = each(keyed.join(decided.where(even > 0), same), even)
    odd = decided.where(F.col(total) % F.col(rows) > 0)
    if not odd.isEmpty():  # what repeated rows can't share evenly
        out = out.unionByName(each(keyed.join(odd, same).dropDuplicates([of_id, of_row]), F.col(total) % F.col(rows)))
    return out
