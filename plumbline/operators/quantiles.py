"""Exact order statistics of groups of any size.

Values are counted in ranges that approximate quantiles cut; running counts tell which range holds a wanted rank, and only
those ranges are read again, counted per distinct value and summed in order. No buffer ever holds a group's values, a
value that a third of all rows share is one count, and an ordering is of one range, which spills where it must.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ranks import with_bucket


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))


def order_statistics(df: DataFrame, keys: list[str], value: str, shares: list[float], name: str = "quantiles") -> DataFrame:
    """(keys, name): the values at ``shares`` of each group's ordered values, linear between neighbours, as an array; rows without a value count nowhere, a group without any has no row. ``df`` is read twice."""
    own = [f"_k{i}" for i in range(len(keys))]
    some = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(value).cast("double").alias("_v"))
    # null keys of a group are a value like others
    parts = [f"_h{i}" for i in range(len(keys))]
    some = some.select("*", *[F.coalesce(F.concat(F.lit("1"), F.col(o).cast("string")), F.lit("0")).alias(h) for o, h in zip(own, parts, strict=True)])
    dealt = with_bucket(some, parts, "_v")
    sizes = dealt.groupBy(*parts, "_b").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*parts)
    held = sizes.select(*parts, "_b", "_c", (F.sum("_c").over(group.orderBy("_b")) - F.col("_c")).alias("_before"), F.sum("_c").over(group).alias("_n"))
    at = [F.lit(float(s)) * (F.col("_n") - 1) for s in shares]
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), (F.floor(h) if side == 0 else F.ceil(h)).cast("long").alias("rank"), (h - F.floor(h)).alias("part")) for i, h in enumerate(at) for side in (0, 1)])
    wanted = held.withColumn("_w", F.filter(ranks, lambda r: (r["rank"] >= F.col("_before")) & (r["rank"] < F.col("_before") + F.col("_c")))).where(F.size("_w") > 0).select(*parts, "_b", "_before", "_w")
    inside = dealt.join(wanted, [*parts, "_b"]).groupBy(*parts, "_b", "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("_before").alias("_before"), F.first("_w").alias("_w"), *[F.first(o).alias(o) for o in own])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*parts, "_b").orderBy("_v"))
    found = inside.withColumn("_upto", upto).withColumn("_w", F.filter("_w", lambda r: (r["rank"] >= F.col("_upto") - F.col("_c")) & (r["rank"] < F.col("_upto")))).where(F.size("_w") > 0)
    each = found.select(*own, *parts, "_v", F.explode("_w").alias("_w"))
    side = lambda k: F.max(F.when(F.col("_w.side") == k, F.col("_v")))
    both = each.groupBy(*parts, F.col("_w.i").alias("_i")).agg(*[F.first(o).alias(o) for o in own], side(0).alias("_lo"), side(1).alias("_hi"), F.first("_w.part").alias("_part"))
    both = both.withColumn("_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part"))
    whole = both.groupBy(*parts).agg(*[F.first(o).alias(o) for o in own], F.transform(F.sort_array(F.collect_list(F.struct("_i", "_q"))), lambda x: x["_q"]).alias(name))
    return whole.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], name).where(F.size(name) > 0)


def with_order_statistics(counted: DataFrame, df: DataFrame, keys: list[str], value: str, shares: list[float], names: list[str]) -> DataFrame:
    """``counted``, one row per group, with the values at ``shares`` as columns; NULL where a group has no value."""
    found = order_statistics(df, keys, value, shares, "_q").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_q")
    both = counted.join(found, _same(keys), "left")
    return both.select(*counted.columns, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)])
