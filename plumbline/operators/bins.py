"""Ranks and bins with the semantics of ranked tertiles, linear quantiles and right-closed cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.quantiles import order_statistics
from plumbline.operators.ranks import numbered


def tertile(rank: Column, n: Column) -> Column:
    """Bin 1 to 3 of a rank from 1 among n: right-closed at the linear thirds of the ranks (not ntile)."""
    return (1 + (3 * (rank - 1) > n - 1).cast("int") + (3 * (rank - 1) > 2 * (n - 1)).cast("int")).cast("long")


def tertiles(df: DataFrame, keys: list[str], by: str, ties: tuple[str, ...], name: str = "tertile") -> DataFrame:
    """Tertiles by stable rank inside each group."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    placed = numbered(df, keys, by, "_place", ties).join(sizes, keys)
    return placed.withColumn(name, tertile(F.col("_place") + 1, F.col("_size"))).drop("_place", "_size")


def cut(x: Column, edges: list[float]) -> Column:
    """0-based bin of right-closed intervals (e0, e1], (e1, e2], ...; NULL outside."""
    out = F.lit(None).cast("long")
    for i in range(len(edges) - 2, -1, -1):
        out = F.when((x > edges[i]) & (x <= edges[i + 1]), i).otherwise(out)
    return out.cast("long")


def quantile_edges(df: DataFrame, keys: list[str], x: str, parts: int) -> DataFrame:
    """(keys, edges): linear-interpolated quantiles, equal edges once."""
    return order_statistics(df, keys, x, [i / parts for i in range(parts + 1)], "edges").withColumn("edges", F.array_distinct("edges"))


def quantile_bins(df: DataFrame, keys: list[str], x: str, parts: int) -> DataFrame:
    """Adds ``bin``: right-closed between the quantile edges, the lowest value included. Edges are one row per group."""
    edges = quantile_edges(df, keys, x, parts)
    both = df.join(edges, keys) if keys else df.join(F.broadcast(edges))
    return both.withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col(x)))).cast("long")).drop("edges")


def smoothed(df: DataFrame, keys: list[str], order: str, x: str, name: str) -> DataFrame:
    """Centred moving average of three rows, fewer at the ends."""
    return df.withColumn(name, F.avg(x).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-1, 1)))
