"""Running numbers in two levels, so that no group has to be ordered in one task."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.lineage import written

BUCKETS = 64


def with_bucket(df: DataFrame, keys: list[str], by: str, name: str = "_b", buckets: int = BUCKETS) -> DataFrame:
    """Adds ``name``, a bucket that rises with ``by`` inside each group. Approximate quantiles cut the buckets, so outliers leave them even; equal values share one."""
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(by, shares, 2000)).alias("_cuts"))
    both = df.join(cuts, keys) if keys else df.join(F.broadcast(cuts))  # without keys: a single row
    return both.withColumn(name, F.size(F.filter("_cuts", lambda c: c < F.col(by))).cast("long")).drop("_cuts")


def numbered(df: DataFrame, keys: list[str], by: str, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``name``, the place (from 0) of each row in its group by the numeric column ``by``, then by ``ties``, which together differ inside a group."""
    rows = with_bucket(df, keys, by)
    sizes = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(*keys, "_b", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(by, *ties)) - 1
    return rows.withColumn("_r", inner).join(before, [*keys, "_b"]).withColumn(name, (F.col("_before") + F.col("_r")).cast("long")).drop("_b", "_r", "_before")


def count_upto(marks: DataFrame, asked: DataFrame, keys: list[str], by: str, name: str, width: int = 4096) -> DataFrame:
    """Adds ``name`` to ``asked``: how many ``marks`` of the same keys have a whole number ``by`` of at most its own. Equal marks are counted first; running sums go over ranges of ``width`` and inside them."""
    bucket = F.floor(F.col(by) / width).alias("_b")
    counts = marks.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("_c")).select("*", bucket)
    sums = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
    ends = sums.select(*keys, "_b", "_n").unionByName(asked.select(*keys, bucket, F.lit(0).cast("long").alias("_n")).distinct())
    before = ends.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n")).select(*keys, "_b", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")).alias("_before"))
    rest = [c for c in asked.columns if c not in (*keys, by)]
    rows = asked.select("*", bucket, F.lit(0).cast("long").alias("_c"), F.lit(1).alias("_ask")).unionByName(counts.withColumn("_ask", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy(*keys, "_b").orderBy(by, "_ask").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumn("_run", F.sum("_c").over(upto)).where("_ask = 1").join(before, [*keys, "_b"])
    return run.select(*keys, by, *rest, (F.col("_before") + F.col("_run")).cast("long").alias(name))


def placed(df: DataFrame, keys: list[str], order: list[str], name: str = "at", size: str = "size", write: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Adds ``name``, the place (from 0) of each row in its group by ``order`` (NULL first), and ``size``, how many rows the group has.

    The rows are dealt and sorted by ranges of keys and order, and written with their places in their tasks; a group of any
    size spans many tasks. Only (group, task) pairs are numbered by windows. Rows that are equal in all of it are told
    apart by where they were read, so a third of all rows may be one.
    """
    by = [*keys, *order, "_placed_read"]
    dealt = df.withColumn("_placed_read", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_placed_read")
    rows = write(dealt.withColumn("_placed_here", F.monotonically_increasing_id()))
    task, place = F.shiftright("_placed_here", 33), F.col("_placed_here").bitwiseAND(F.lit((1 << 33) - 1))
    parts = rows.groupBy(*keys, task.alias("_placed_task")).agg(F.min(place).alias("_placed_first"), F.count(F.lit(1)).alias("_placed_n"))
    group = Window.partitionBy(*keys)
    before = F.sum("_placed_n").over(group.orderBy("_placed_task")) - F.col("_placed_n") - F.col("_placed_first")
    # written, so that its size is known when the join is planned: as many rows as tasks and groups
    starts = write(parts.select(*[F.col(k).alias(f"_placed_k{i}") for i, k in enumerate(keys)], "_placed_task", before.alias("_placed_before"), F.sum("_placed_n").over(group).alias(size)))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_placed_k{i}")) for i, k in enumerate(keys)], task == F.col("_placed_task"))
    return rows.join(starts, same).select(*df.columns, (F.col("_placed_before") + place).alias(name), size)
