"""Connected components of an edge table, by Spark rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node reachable.

    Rounds of large-star and small-star steps: each node's neighbours are tied to the smallest of them, until nothing changes. A hub's
    minimum is found by partial aggregation; the join that brings it to the hub's edges deals them by the hub, and Spark's splitting of
    skewed joins (spark.sql.adaptive.skewJoin) is what spreads a large one. Loops are ignored; an empty table gives none. Each round is
    written to the shared folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        tied = both.join(least, "u")
        if large:
            out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        now = written(star(star(now, True), False), "edges")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == mark:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
