"""Two-level scans: running sums and last known values over keys of any length, no key in one task.

A key's rows are cut into blocks that follow its order. Windows run inside blocks; what the earlier blocks of the key add is scanned over
one row a block and joined back. A key of all rows uses all cores; only the block table, smaller by the size of a block, meets by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPAN = 1 << 14  # ordinals a block, where the order is an ordinal


def steady(spark: SparkSession) -> None:
    """Let no union pass for partitioned by what its inputs are partitioned by.

    Spark 4.1 takes it for that (spark.sql.unionOutputPartitioning), also where adaptive execution then reads one input in other partitions; rows
    of one key stay apart, and a window or an aggregate over the union gives wrong rows.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def scan(rows: DataFrame, key: list[str], order: list[str], block: Column, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, own: bool = True, backwards: bool = False) -> DataFrame:
    """`rows` with, by key in order, the sum of each of `sums` over the rows before, and the last value that is not null of each of `lasts`
    up to the row itself (`own`) or before it; `backwards` goes through the order from its end.

    `block` must not decrease along the order. Sums are long, 0 for the first row; rows that tie in the order may come in either order. The
    rows are read twice, whole and as one row a block: a caller whose rows are dear writes them first.
    """
    steady(rows.sparkSession)
    sums, lasts = sums or {}, lasts or {}
    way = F.desc if backwards else F.asc
    tagged = rows.withColumn("_block", block)
    inside = Window.partitionBy(*key, "_block").orderBy(*[way(c) for c in order])
    before, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    local = tagged.repartition(*key, "_block").withColumns({f"_{n}": F.sum(c).over(before) for n, c in sums.items()} | {f"_{n}": F.last(c, ignorenulls=True).over(upto) for n, c in lasts.items()})
    pick, at = F.min_by if backwards else F.max_by, F.struct(*order)
    whole = tagged.groupBy(*key, "_block").agg(*[F.sum(c).alias(f"_whole_{n}") for n, c in sums.items()], *[pick(c, F.when(c.isNotNull(), at)).alias(f"_whole_{n}") for n, c in lasts.items()])
    earlier = Window.partitionBy(*key).orderBy(way("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select(*key, "_block", *[F.sum(f"_whole_{n}").over(earlier).alias(f"_carry_{n}") for n in sums], *[F.last(f"_whole_{n}", ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in lasts])
    added = [(F.coalesce(f"_carry_{n}", F.lit(0)) + F.coalesce(f"_{n}", F.lit(0))).cast("long").alias(n) for n in sums]
    return local.join(carry, [*key, "_block"]).select(*rows.columns, *added, *[F.coalesce(f"_{n}", f"_carry_{n}").alias(n) for n in lasts])


def span(column: str | Column, size: int = SPAN) -> Column:
    """The block of an ordinal."""
    return F.floor((F.col(column) if isinstance(column, str) else column) / size)
