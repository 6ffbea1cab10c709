"""Exact percentiles and distribution functions of groups of any size, without a task that sorts or holds a group.

Percentiles by distributed selection: a range of values that holds a wanted rank is cut into ``RANGES`` equal parts, whose counts (partial before
the shuffle, at most ``RANGES`` rows for a rank) tell which part holds it; only that part is cut further, between the smallest and the largest value
in it, until both are the same or few enough values are left to be sorted (``SORTED``). Distribution functions by range offsets: distinct values are dealt by ranges, and a value's count is that of the
ranges before its own and of the smaller values in it; copies of one value are one row before they meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.storage import Stored

#: Parts of a range, and values that are sorted at most.
RANGES, SORTED = 1024, 4096


def _same(keys: list[str], suffix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}{suffix}")) for k in keys], F.lit(True))


def order_statistics(rows: DataFrame, keys: list[str], column: str, fractions: list[float], kept: bool = False) -> DataFrame:
    """keys, fraction, at (the place between two ranks), low and high: the values of the ranks around ``fraction * (n - 1)``. Null and NaN values don't count.

    ``kept``: the rows are a stored table, which isn't written once more."""
    d = rows.select(*keys, F.col(column).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    d = d if kept else Stored(d).df
    groups = d.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    wanted = groups.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))).withColumn("at", F.col("fraction") * (F.col("n") - 1))
    whole = Stored(wanted)
    ranks = whole.df.select(*keys, "lo", "hi", "n", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    # lo and hi are values that occur, n the number of values from lo to hi, below the number of smaller ones
    state = Stored(ranks.withColumn("below", F.lit(0).cast("long")))
    found, few = [], []

    def inside(ranges: DataFrame) -> DataFrame:
        named = ranges.select(*[F.col(k).alias(f"{k}__r") for k in keys], "rank", "lo", "hi", "below")
        return d.join(named, _same(keys, "__r") & F.col("__v").between(F.col("lo"), F.col("hi")))

    while True:
        found.append(state.df.where("lo = hi").select(*keys, "rank", F.col("lo").alias("value")))
        few.append(state.df.where(f"lo < hi and n <= {SORTED}"))
        many = state.df.where(f"lo < hi and n > {SORTED}")
        if many.isEmpty():
            break
        # halves first, as hi - lo may be no number
        share = (F.col("__v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        part = F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).cast("int")
        counts = inside(many).groupBy(*keys, "rank", "below", part.alias("part")).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        order = Window.partitionBy(*keys, "rank").orderBy("part")  # RANGES rows at most
        placed = counts.withColumn("upto", F.col("below") + F.sum("n").over(order))
        hit = placed.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        state = Stored(hit.select(*keys, "lo", "hi", "n", "rank", (F.col("upto") - F.col("n")).alias("below")))
    order = Window.partitionBy(*keys, "rank").orderBy("__v")  # SORTED rows at most
    placed = inside(reduce(DataFrame.unionByName, few)).withColumn("place", F.col("below") + F.row_number().over(order) - 1)
    found.append(placed.where("place = rank").select(*keys, "rank", F.col("__v").alias("value")))
    values = Stored(reduce(DataFrame.unionByName, found)).df
    side = lambda name, edge: values.select(*[F.col(k).alias(f"{k}__{name}") for k in keys], F.col("rank").alias(f"__{edge}"), F.col("value").alias(name))
    out = whole.df.withColumns({"__f": F.floor("at"), "__c": F.ceil("at")})
    for name, edge, own in (("low", "lo_rank", "__f"), ("high", "hi_rank", "__c")):
        out = out.join(side(name, edge), _same(keys, f"__{name}") & (F.col(own) == F.col(f"__{edge}")))
    return out.select(*keys, "fraction", "at", "low", "high")


def percentiles(rows: DataFrame, keys: list[str], column: str, fractions: dict[str, float], kept: bool = False) -> DataFrame:
    """keys and one column for each named fraction: the value between the two ranks around it, interpolated."""
    found = order_statistics(rows, keys, column, list(fractions.values()), kept)
    share = F.col("at") - F.floor("at")
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") * (1 - share) + F.col("high") * share)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("fraction") == float(f), value)).alias(name) for name, f in fractions.items()])


def cumulative(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, the distinct values of a column, their count, upto (rows of the group with that value or a smaller one), and n (rows of the group)."""
    counts = rows.groupBy(*keys, column).agg(F.count("*").alias("count"))
    dealt = Stored(counts.repartitionByRange(*keys, column).withColumn("__range", F.spark_partition_id())).df
    sums = dealt.groupBy(*keys, "__range").agg(F.sum("count").alias("sum"))
    before = sums.withColumns({"before": F.sum("sum").over(Window.partitionBy(*keys).orderBy("__range")) - F.col("sum"), "n": F.sum("sum").over(Window.partitionBy(*keys))})  # a row for each range
    named = before.select(*[F.col(k).alias(f"{k}__r") for k in keys], F.col("__range").alias("__r"), "before", "n")
    own = Window.partitionBy(*keys, "__range").orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = dealt.withColumn("inside", F.sum("count").over(own)).join(named, _same(keys, "__r") & (F.col("__range") == F.col("__r")))
    return joined.select(*keys, column, "count", (F.col("before") + F.col("inside")).alias("upto"), "n")


def ecdf(rows: DataFrame, keys: list[str], column: str, name: str = "ecdf") -> DataFrame:
    """The rows, each with the share of its group's rows that have its value or a smaller one."""
    of = cumulative(rows, keys, column)
    named = of.select(*[F.col(k).alias(f"{k}__c") for k in keys], F.col(column).alias("__v"), (F.col("upto") / F.col("n")).alias(name))
    return rows.join(named, _same(keys, "__c") & F.col(column).eqNullSafe(F.col("__v"))).drop(*[f"{k}__c" for k in keys], "__v")
