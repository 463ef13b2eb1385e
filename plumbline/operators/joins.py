"""Joins and domains that raise where data break their promise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def covered_join(df: DataFrame, block: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of ``block``: an error where a row has no partner, or a key of the block comes twice."""
    once = block.groupBy(*keys).agg(F.count(F.lit(1)).alias("_times"), *[F.min(c).alias(c) for c in block.columns if c not in keys])
    joined = df.join(once, keys, "left")
    at = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    fault = F.when(F.col("_times").isNull(), F.raise_error(F.concat(F.lit("no row of the block for "), at))).when(F.col("_times") > 1, F.raise_error(F.concat(F.lit("several rows of the block for "), at)))
    return joined.where(fault.isNull()).drop("_times")


def closed(x: Column, values: list[str]) -> Column:
    """The value where it is one of ``values``, else an error."""
    return F.when(x.isin(*values), x).otherwise(F.raise_error(F.concat(F.lit("unknown value: "), F.coalesce(x, F.lit("NULL")))))
