"""Kernel densities of groups of any size (P10): values become weights of a fixed number of bins, and bins are convolved with the kernel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.storage import Stored

#: Bins of a group (its rows after grouping, at most), and points at which the density is given.
BINS, POINTS = 2048, 100


def densities(rows: DataFrame, keys: list[str], column: str, points: int = POINTS) -> DataFrame:
    """keys, x, density, bandwidth: a Gaussian kernel with Scott's bandwidth, at ``points`` places from the smallest to the largest value.

    A value's weight is shared by the two bins around it, so the error is of second order in the bins' width. Null and NaN values don't count. A
    group of one value, or of equal ones, has one place and no density.
    """
    import pandas as pd

    d = Stored(rows.select(*keys, F.col(column).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))).df  # read twice
    stats = d.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.stddev_samp("__v").alias("std")).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    at = F.when(F.col("hi") > F.col("lo"), (F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (BINS - 1)).otherwise(0.0)
    placed = d.join(stats, same).select(*keys, "n", "lo", "hi", "std", at.alias("at"))
    share = F.col("at") - F.floor("at")
    ends = F.array(F.struct(F.floor("at").alias("bin"), (1 - share).alias("w")), F.struct((F.floor("at") + 1).alias("bin"), share.alias("w")))
    bins = placed.select(*keys, "n", "lo", "hi", "std", F.explode(ends).alias("e")).groupBy(*keys, "n", "lo", "hi", "std", "e.bin").agg(F.sum("e.w").alias("w"))

    def convolved(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        n, lo, hi, std = (group[c].iloc[0] for c in ("n", "lo", "hi", "std"))
        head = {k: group[k].iloc[0] for k in keys}
        if not hi > lo:
            return pd.DataFrame([head | {"x": lo, "density": None, "bandwidth": None}]).astype({"density": "float64", "bandwidth": "float64"})
        weights = np.zeros(BINS)
        inside = group["bin"].to_numpy() < BINS  # the last value's second share is nothing
        weights[group["bin"].to_numpy()[inside]] = group["w"].to_numpy()[inside]
        width, step = std * n**-0.2, (hi - lo) / (BINS - 1)
        reach = min(BINS - 1, int(np.ceil(6 * width / step)))
        kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) * step / width) ** 2)
        smooth = np.convolve(weights, kernel)[reach : reach + BINS] / (n * width * np.sqrt(2 * np.pi))
        x = np.linspace(lo, hi, points)
        return pd.DataFrame(head | {"x": x, "density": np.interp(x, lo + np.arange(BINS) * step, smooth), "bandwidth": width})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields if f.name != "__v")
    return bins.groupBy(*keys).applyInPandas(convolved, f"{schema}, x double, density double, bandwidth double")
