"""Seeded splits, folds, samples and draws; randomness is integer arithmetic or md5, so every engine agrees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from plumbline.operators.lineage import written
from plumbline.operators.ranks import count_upto, numbered, placed


def lcg(x: Column) -> Column:
    """The high bits of one step of a linear congruence modulo 2**31."""
    return F.floor(((x * 1_103_515_245 + 12_345) % 2_147_483_648) / 65_536)


def donors(cases: DataFrame, key: str, source: str, split: str, k: str) -> DataFrame:
    """(key, k, donor, donor_k, fallback) of the cases with two windows or more. Eligible: another source, the same split, at least as many windows.

    The draw is uniform over the eligible donors, yet no pair is ever listed. All are numbered once per split by falling
    windows, then id, so those with at least k windows are the first n of them. With r the draw, the answer is place
    r + j, where j counts the donors of the case's own source with at most r others before them. Without an eligible
    donor the one with most windows of another source serves; for that, two best sources per split suffice. ``cases`` is
    read several times: better written than derived.
    """
    own = cases.select(F.col(key).alias("id"), F.col(source).alias("src"), F.col(split).alias("part"), F.col(k).alias("k")).where("k >= 2")

    def longer(*keys: str) -> DataFrame:
        """(keys, k, n, before): how many have at least, and more than, k windows."""
        n = own.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(F.desc("k")))
        return n.select(*keys, "k", upto.alias("n"), (upto - F.col("c")).alias("before"))

    placed = numbered(numbered(own, ["part", "k"], "id", "place"), ["part", "src", "k"], "id", "mine")
    same = longer("part", "src").withColumnsRenamed({"n": "n_same", "before": "before_same"})
    placed = placed.join(longer("part"), ["part", "k"]).join(same, ["part", "src", "k"])
    placed = placed.select("part", "src", "id", "k", (F.col("place") + F.col("before")).alias("place"), (F.col("mine") + F.col("before_same")).alias("mine"), (F.col("n") - F.col("n_same")).alias("m"))
    placed = written(placed)
    drawn = placed.where("m > 0").select("part", "src", "id", "k", (lcg(F.col("id")) % F.col("m")).cast("long").alias("v"))
    at = count_upto(placed.select("part", "src", (F.col("place") - F.col("mine")).alias("v")), drawn, ["part", "src"], "v", "j").withColumn("place", F.col("v") + F.col("j"))
    found = at.select("part", "place", "id", "k").join(placed.select("part", "place", F.col("id").alias("donor"), F.col("k").alias("donor_k")), ["part", "place"])
    picked = found.select(F.col("id").alias(key), F.col("k").alias(k), "donor", "donor_k", F.lit(False).alias("fallback"))

    most = own.groupBy("part", "src").agg(F.max(F.struct("k", "id")).alias("best"))
    two = most.groupBy("part").agg(F.max(F.struct("best", "src")).alias("first")).join(most, "part").groupBy("part", "first").agg(F.max(F.when(F.col("src") != F.col("first.src"), F.col("best"))).alias("second"))
    left = placed.where("m <= 0").join(two, "part").withColumn("b", F.when(F.col("first.src") != F.col("src"), F.col("first.best")).otherwise(F.col("second"))).where("b is not null")
    return picked.unionByName(left.select(F.col("id").alias(key), F.col("k").alias(k), F.col("b.id").alias("donor"), F.col("b.k").alias("donor_k"), F.lit(True).alias("fallback")))


def prefix_donors(cases: DataFrame, pool: DataFrame, budget: int, chunk: int = 8) -> DataFrame:
    """(id, place, donor, before, used): donors of another source of the same part in a seeded order until ``budget`` is reached, the last one cut.

    ``cases``: (id, src, part); ``pool``: (id, src, part, size), both better written than derived. The pool of a part is
    put in one seeded order, and each case reads it round from a place of its own. Rounds fetch ``chunk`` places per open
    case, then four times as many, until all are full or have read the whole pool, so no pair is listed beyond need.
    Sides with a row per text are merged, as hinted: by the size of their files, in which ids take next to nothing, Spark
    would collect them on the driver to broadcast them.
    """
    order = (F.col("id") * 7919) % 1_000_003 * 2_147_483_648 + F.col("id")
    ring = written(numbered(pool.withColumn("_order", order), ["part"], "_order", "at").select("part", "at", F.col("id").alias("donor"), F.col("src").alias("donor_src"), "size"))
    sizes = pool.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per part
    open_ = cases.join(sizes, "part").select("id", "src", "part", "n", (lcg(F.col("id")) % F.col("n")).cast("long").alias("from"), F.lit(0).cast("long").alias("got"), F.lit(0).cast("long").alias("read"))
    out = None
    while True:
        each = open_.withColumn("place", F.explode(F.sequence("read", F.least(F.col("read") + chunk, F.col("n")) - 1)))
        met = each.withColumn("at", (F.col("from") + F.col("place")) % F.col("n")).join(ring.hint("merge"), ["part", "at"]).where("src <> donor_src")
        run = F.sum("size").over(Window.partitionBy("id").orderBy("place")) - F.col("size") + F.col("got")
        taken = written(met.withColumn("before", run).where(F.col("before") < budget).select("id", "place", "donor", "before", F.least("size", budget - F.col("before")).cast("long").alias("used")))
        out = taken if out is None else out.unionByName(taken)
        more = taken.groupBy("id").agg(F.sum("used").alias("more"))
        open_ = open_.join(more.hint("merge"), "id", "left").select("id", "src", "part", "n", "from", (F.col("got") + F.coalesce("more", F.lit(0))).alias("got"), (F.col("read") + chunk).alias("read"))
        open_ = written(open_.where((F.col("got") < budget) & (F.col("read") < F.col("n"))))
        if open_.isEmpty():
            return out
        chunk *= 4


def hash_order(seed: int, *columns: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def balanced_sample(df: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """The first rows of each class in a seeded order: as many as the smallest class has, n at most."""
    counts = df.groupBy(label).count().agg(F.least(F.min("count"), F.lit(n)).alias("_n"))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(hash_order(seed, F.col(key)), key)))
    # the constant bound drops rows before the shuffle
    return ranked.where(F.col("_r") <= n).join(F.broadcast(counts)).where("_r <= _n").drop("_r", "_n")  # one row


def random_folds(groups: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """(group, fold): groups in a seeded order, dealt round."""
    own = groups.select(group).distinct().withColumn("_h", hash_order(seed, F.col(group)))
    return placed(own, [], ["_h", group], "_at").select(group, (F.col("_at") % k).alias("fold"))


def _taken(weight: np.ndarray, size: int, n: int) -> np.ndarray:
    """Of ``n`` groups of one size, dealt one by one to the lightest fold (ties to the first), how many each fold takes.

    Fold j takes its t-th at level weight[j] + t * size, and the levels of all folds are met in order of (level, fold).
    """
    k = len(weight)
    lo, hi = np.zeros(k, np.int64), np.full(k, n, np.int64)
    first = np.arange(k)
    while (lo < hi).any():  # the least t of each fold that comes n-th or later
        t = (lo + hi) // 2
        gap = weight[:, None] - weight[None, :] + t[:, None] * size  # from fold i's level 0 to fold j's level t
        ahead = np.where(first[None, :] < first[:, None], gap // size + 1, -(-gap // size))
        late = np.maximum(ahead, 0).sum(1) >= n
        lo, hi = np.where(late, lo, np.minimum(t + 1, hi)), np.where(late, t, hi)
    return lo


def greedy_folds(groups: DataFrame, group: str, n: str, k: int) -> DataFrame:
    """(group, fold) of rows (group, n), one per group: groups by falling size (ties by name), each to the lightest fold (ties to the first).

    Groups of one size differ only by their place among them, so the choice runs over sizes and how many groups have each;
    rows of all groups make at most the root of twice their number of distinct sizes, which one task passes in order.
    What it tells of a size, the folds' weights before it, is joined to its groups, and each takes its fold by its place.
    """
    own = written(placed(groups.select(group, F.col(n).cast("long").alias("_n")), ["_n"], [group], "_at"))
    sizes = own.groupBy("_n").agg(F.count(F.lit(1)).alias("_c"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(k, np.int64)
        for b in batches:
            before = []
            for size, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                before.append(weight.tolist())
                weight = weight + (_taken(weight, size, c) if size else np.bincount([int(weight.argmin())], [c], k).astype(np.int64)) * size
            yield pa.record_batch([b.column(0), pa.array(before, pa.list_(pa.int64()))], names=["_n", "_w"])

    told = sizes.repartition(1).sortWithinPartitions(F.desc("_n")).mapInArrow(dealt, "_n long, _w array<long>")

    @pandas_udf("long")
    def fold(at: pd.Series, size: pd.Series, weights: pd.Series) -> pd.Series:
        out = []
        for r, s, w in zip(at, size, weights, strict=True):
            w = np.asarray(w, np.int64)
            # the r-th goes to the fold that takes one more of r + 1 groups than of r
            out.append(int(w.argmin()) if not s else int((_taken(w, s, r + 1) - _taken(w, s, r)).argmax()))
        return pd.Series(out)

    return own.join(told, "_n").select(group, fold("_at", "_n", "_w").alias("fold"))
