"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm._shared import Stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp: the smallest node reachable. Nodes without an edge don't appear.

    Labels go to neighbours and then jump to their labels' labels, until a round changes none. A node of very many
    edges is a hot key of a plain join (AQE splits it) and of a grouped minimum (pre-aggregated before the shuffle).
    """
    both = Stored(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).where("node <> other").distinct())
    labels = Stored(both.df.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("comp")))
    while True:
        heard = both.df.join(labels.df.select(F.col("node").alias("other"), F.col("comp").alias("heard")), "other").groupBy("node").agg(F.min("heard").alias("heard"))
        step = Stored(labels.df.join(heard, "node").select("node", F.least("comp", "heard").alias("comp"), F.col("comp").alias("was")))
        jump = step.df.select(F.col("node").alias("comp"), F.col("comp").alias("jump"))
        new = Stored(step.df.join(jump, "comp", "left").select("node", F.coalesce("jump", "comp").alias("comp"), "was"))
        step.drop()
        labels.drop()
        labels = new
        if new.df.where("comp <> was").isEmpty():
            both.drop()
            return new.df.select("node", "comp")
