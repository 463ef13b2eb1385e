"""Cluster bootstrap of AUCs by weight vectors.

How often each of B replicates draws a cluster is one vector of B small counts per cluster. A row takes its cluster's
vector along, scores are dealt to ranges, and a task that has a range in order sums the vectors of positives and of
negatives as it goes: at each score, the wins of its positives over all negatives before them, in all replicates at once.
Ranges are then joined the same way, each with the negatives of all before it. So the work is rows times B, in batches,
with a few vectors in memory; there is no pair of clusters, no replicated row, and any number of series (groups,
detectors, runs) go through one plan. Rows that share a score are summed before they are dealt, so a score that a third
of all rows have is no single task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.lineage import written
from plumbline.operators.ranks import placed, with_bucket

PRIME = 2_147_483_647
#: Clusters whose vectors one row of draws holds, clusters that one task counts, and rows of one score that are summed at once.
BLOCK, RANGE, TIES = 1024, 1 << 22, 8


def _mixed(x: np.ndarray) -> np.ndarray:
    """A pseudorandom integer below PRIME; no step leaves 64 bits."""
    x = (x * x + 69_621) % PRIME
    x = (x * 48_271 + 11) % PRIME
    x = (x * x + 7) % PRIME
    return (x * 16_807 + 3) % PRIME


def draws(b: int, k: np.ndarray, m: int, seed: int) -> np.ndarray:
    """Which of ``m`` clusters the draws ``k`` of replicate ``b`` take."""
    return _mixed((b * 7_368_787 + k * 1_299_721 + seed) % PRIME) * m // PRIME


def draw_weights(spark: SparkSession, clusters: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """(cluster, w): the counts of each cluster in all replicates, one byte each; a replicate draws as many clusters as there are."""
    numbered = written(placed(clusters.select("cluster"), [], ["cluster"], "c"))
    m = numbered.count()
    some = max(1, min(64, RANGE // max(m, 1)))  # replicates of one task

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, lo in zip(*[batch.column(i).to_pylist() for i in (0, 1)], strict=True):
                n, hi = min(some, replicates - first), min(lo + RANGE, m)
                held = np.zeros((n, hi - lo), np.uint8)
                for b in range(n):
                    total = np.zeros(hi - lo, np.int64)
                    for k in range(0, m, 1 << 20):
                        c = draws(first + b, np.arange(k, min(k + (1 << 20), m), dtype=np.int64), m, seed)
                        total += np.bincount(c[(c >= lo) & (c < hi)] - lo, minlength=hi - lo)
                    if total.max(initial=0) > 255:
                        raise ValueError("a cluster is drawn more often than a byte can tell")
                    held[b] = total
                for at in range(0, hi - lo, BLOCK):
                    yield pa.record_batch([[(lo + at) // BLOCK], [first], [held[:, at : at + BLOCK].T.tobytes()]], names=["block", "first", "counts"])

    def joined(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        parts = sorted(zip(table.column("first").to_pylist(), table.column("counts").to_pylist(), strict=True))
        size = min(BLOCK, m - block * BLOCK)
        whole = np.hstack([np.frombuffer(c, np.uint8).reshape(size, -1) for _, c in parts])
        return pa.table({"c": np.arange(block * BLOCK, block * BLOCK + size), "w": pa.array([row.tobytes() for row in whole], pa.binary())})

    firsts = spark.range(0, replicates, some).withColumnRenamed("id", "first")
    tasks = firsts.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(m - 1, 0)).cast("long"), F.lit(RANGE).cast("long"))))
    vectors = tasks.mapInArrow(count, "block long, first long, counts binary").groupBy("block").applyInArrow(joined, "c long, w binary")
    return numbered.join(vectors, "c").select("cluster", "w")


ROWS = "_key string, _b long, _s double, _p long, _n long, w binary, pv binary, nv binary"


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch, rows (_key, _b, _s, _p, _n, w) that share a score as one row of summed vectors, others as they are."""
    types = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    for batch in batches:
        pdf = batch.to_pandas()
        size = pdf.groupby(["_key", "_b", "_s"])["w"].transform("size")
        few, many = pdf[size < TIES], pdf[size >= TIES].sort_values(["_key", "_b", "_s"])
        columns = [few[c].tolist() for c in ("_key", "_b", "_s", "_p", "_n", "w")] + [[None] * len(few)] * 2
        out = [columns]
        if len(many):
            for (key, bucket, score), rows in many.groupby(["_key", "_b", "_s"]):
                w = np.stack([np.frombuffer(x, np.uint8) for x in rows["w"]]).astype(np.int64)
                sums = [(w * rows[c].to_numpy()[:, None]).sum(0).tobytes() for c in ("_p", "_n")]
                out.append([[key], [bucket], [score], [0], [0], [None], *[[s] for s in sums]])
        for columns in out:
            if columns[0]:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["_key", "_b", "_s", "_p", "_n", "w", "pv", "nv"])


class _Range:
    """Sums over one range of scores of a series, whose rows come in order: wins inside it, positives, negatives, per replicate."""

    def __init__(self, replicates: int):
        self.u, self.p, self.n = (np.zeros(replicates) for _ in range(3))
        self.last, self.held = None, None

    def take(self, score: np.ndarray, p: np.ndarray, n: np.ndarray) -> None:
        """Sums of positives and of negatives (scores, replicates), scores rising; the last one may go on in the next batch."""
        if self.last is not None:
            if self.last == score[0]:
                p[0] += self.held[0]
                n[0] += self.held[1]
            else:
                self._count(self.held[0][None], self.held[1][None])
        self._count(p[:-1], n[:-1])
        self.last, self.held = score[-1], (p[-1].copy(), n[-1].copy())

    def _count(self, p: np.ndarray, n: np.ndarray) -> None:
        before = np.cumsum(n, 0) - n + self.n
        self.u += (p * (before + n / 2)).sum(0)
        self.p += p.sum(0)
        self.n += n.sum(0)

    def end(self) -> list[bytes]:
        if self.last is not None:
            self._count(self.held[0][None], self.held[1][None])
        return [x.tobytes() for x in (self.u, self.p, self.n)]


def _scanned(replicates: int, rows: int = 256):
    """(_key, _b, u, p, n) of ROWS sorted by series, range and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array([x], t) for x, t in zip((*at, *now.end()), (pa.string(), pa.int64(), *[pa.binary()] * 3), strict=True)], names=["_key", "_b", "u", "p", "n"])

        for batch in batches:
            cols = {name: batch.column(name).to_pylist() for name in ("_key", "_b", "w", "pv", "nv")}
            s, p, n = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("_s", "_p", "_n"))
            places = list(zip(cols["_key"], cols["_b"], strict=True))
            a = 0
            while a < len(places):
                z = a + 1
                while z < len(places) and z < a + rows and places[z] == places[a]:
                    z += 1
                if places[a] != at:
                    if now is not None:
                        yield told()
                    at, now = places[a], _Range(replicates)
                pv, nv = np.zeros((z - a, replicates), np.int64), np.zeros((z - a, replicates), np.int64)
                for i in range(a, z):
                    if cols["w"][i] is not None:
                        w = np.frombuffer(cols["w"][i], np.uint8)
                        np.multiply(w, p[i], out=pv[i - a])
                        np.multiply(w, n[i], out=nv[i - a])
                    else:
                        pv[i - a], nv[i - a] = np.frombuffer(cols["pv"][i], np.int64), np.frombuffer(cols["nv"][i], np.int64)
                edges = np.flatnonzero(np.r_[True, np.diff(s[a:z]) != 0])
                now.take(s[a:z][edges], np.add.reduceat(pv, edges), np.add.reduceat(nv, edges))
                a = z
        if now is not None:
            yield told()

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_key, b, auc) of ranges sorted by series and range; replicates with one class only are absent."""
    key, u, p, n = None, None, None, None

    def told() -> pa.RecordBatch:
        pairs = p * n
        some = np.flatnonzero(pairs > 0)
        return pa.record_batch([pa.array([key] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(u[some] / pairs[some], pa.float64())], names=["_key", "b", "auc"])

    for batch in batches:
        for k, *held in zip(*[batch.column(c).to_pylist() for c in ("_key", "u", "p", "n")], strict=True):
            du, dp, dn = (np.frombuffer(x) for x in held)
            if k != key:
                if key is not None:
                    yield told()
                key, u, p, n = k, np.zeros(len(du)), np.zeros(len(du)), np.zeros(len(du))
            u = u + du + dp * n
            p, n = p + dp, n + dn
    if key is not None:
        yield told()


def replicate_aucs(df: DataFrame, series: list[str], cluster: str, score: str, label: str, weights: DataFrame, replicates: int) -> DataFrame:
    """(series, b, auc) per series and replicate, from (cluster, w); ties count half. Rows without score or label drop out."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    key = F.to_json(F.struct(*series)) if series else F.lit("{}")
    rows = rows.groupBy(key.alias("_key"), F.col(cluster).alias("cluster"), F.col(score).cast("double").alias("_s")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    ranged = with_bucket(rows, ["_key"], "_s").join(weights, "cluster").select("_key", "_b", "_s", "_p", "_n", "w")
    dealt = ranged.mapInArrow(_tied, ROWS).repartition(parts, "_key", "_b").sortWithinPartitions("_key", "_b", "_s")
    sums = dealt.mapInArrow(_scanned(replicates), "_key string, _b long, u binary, p binary, n binary")
    found = sums.repartition(parts, "_key").sortWithinPartitions("_key", "_b").mapInArrow(_joined, "_key string, b long, auc double")
    if not series:
        return found.select("b", "auc")
    schema = df.select(*series).schema
    return found.withColumn("_k", F.from_json("_key", schema)).select("_k.*", "b", "auc")


def paired_differences(df: DataFrame, keys: list[str], cluster: str, a: str, b: str, label: str, weights: DataFrame, replicates: int) -> DataFrame:
    """(keys, b, diff): AUC of column ``a`` minus AUC of column ``b``, per group and replicate."""
    long_ = df.unpivot([*keys, cluster, label], [a, b], "_f", "_v")
    each = replicate_aucs(long_, [*keys, "_f"], cluster, "_v", label, weights, replicates)
    value = lambda f: F.max(F.when(F.col("_f") == f, F.col("auc")))
    return each.groupBy(*keys, "b").agg((value(a) - value(b)).alias("diff")).where("diff is not null")


def interval(diffs: DataFrame, *keys: str, column: str = "diff") -> DataFrame:
    """Mean, 95 % percentile interval, share of replicates at or below zero, and significance."""
    q = lambda p: F.percentile(column, F.lit(p))
    out = diffs.groupBy(*keys).agg(F.avg(column).alias("mean"), q(0.025).alias("lo"), q(0.975).alias("hi"), F.avg((F.col(column) <= 0).cast("double")).alias("p_le0"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


def significance(lo: Column, hi: Column) -> Column:
    return (lo > 0) | (hi < 0)
