"""Ranking metrics over any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ranks import with_bucket


def _counts(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """(keys, _s, _p, _n): positives and negatives per distinct score; rows without score or label drop out."""
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    return rows.groupBy(*keys, F.col(score).cast("double").alias("_s")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))


def auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """(keys, auc, n_pos, n_neg): area under the ROC curve with ties counted half; NULL where a class is missing.

    Scores are counted before anything is ordered; negatives below a score are summed in two levels.
    """
    counts = with_bucket(_counts(df, keys, score, label), keys, "_s")
    sums = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m"))
    below = sums.withColumn("_below", F.sum("_m").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_m")).drop("_m")
    inner = Window.partitionBy(*keys, "_b").orderBy("_s")
    ranked = counts.withColumn("_run", F.sum("_n").over(inner) - F.col("_n")).join(below, [*keys, "_b"])
    won = F.sum(F.col("_p") * (F.col("_below") + F.col("_run") + F.col("_n") / F.lit(2.0)))
    found = ranked.groupBy(*keys).agg(won.alias("_u"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))
    return found.select(*keys, F.try_divide("_u", F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def average_precision(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """(keys, ap): the step-wise sum of precision over recall, scores falling. Running sums go over buckets of scores and inside them."""
    counts = with_bucket(_counts(df, keys, score, label), keys, "_s")
    sums = counts.groupBy(*keys, "_b").agg(F.sum("_p").alias("_tp"), F.sum(F.col("_p") + F.col("_n")).alias("_all"))
    falling = Window.partitionBy(*keys).orderBy(F.desc("_b"))
    above = sums.select(*keys, "_b", *[(F.sum(c).over(falling) - F.col(c)).alias(f"{c}_above") for c in ("_tp", "_all")])
    inner = Window.partitionBy(*keys, "_b").orderBy(F.desc("_s"))
    run = counts.withColumns({"_tp": F.sum("_p").over(inner), "_all": F.sum(F.col("_p") + F.col("_n")).over(inner)}).join(above, [*keys, "_b"])
    precision = (F.col("_tp") + F.col("_tp_above")) / (F.col("_all") + F.col("_all_above")).cast("double")
    found = run.groupBy(*keys).agg(F.sum(F.col("_p") * precision).alias("_won"), F.sum("_p").alias("_pos"))
    return found.select(*keys, F.try_divide("_won", F.col("_pos").cast("double")).alias("ap"))


def auc_over(df: DataFrame, groupings: list[list[str]], score: str, label: str) -> DataFrame:
    """AUC of several independent groupings and totals in one table: (grouping, member, auc, n_pos, n_neg).

    Rows are counted per score and group once (one Expand, as for grouping sets) before any ordering.
    """
    member = lambda g: F.concat_ws("/", *[F.col(c).cast("string") for c in g]) if g else F.lit("all")
    tags = F.explode(F.array(*[F.struct(F.lit("+".join(g) or "all").alias("grouping"), member(g).alias("member")) for g in groupings])).alias("_g")
    return auc(df.select(tags, score, label).select("_g.grouping", "_g.member", score, label), ["grouping", "member"], score, label)


def directed_auc(df: DataFrame, dev: Column, keys: list[str], score: str, label: str) -> DataFrame:
    """(keys, dev_auc, auc): AUC outside ``dev`` with the sign that makes the AUC on ``dev`` at least one half."""
    first = auc(df.where(dev), keys, score, label).select(*keys, F.col("auc").alias("dev_auc"))
    rest = auc(df.where(~dev), keys, score, label).select(*keys, F.col("auc").alias("_a"))
    return rest.join(first, keys).select(*keys, "dev_auc", F.when(F.col("dev_auc") < 0.5, 1 - F.col("_a")).otherwise(F.col("_a")).alias("auc"))
