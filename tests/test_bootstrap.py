"""Replicates by weight vectors against replicates by repeated rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import bootstrap


def plain_auc(y, s):
    pos, neg = [v for v, k in zip(s, y) if k], [v for v, k in zip(s, y) if not k]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


@pytest.mark.parametrize("ties", [1, 8])
def test_replicates(spark, ties, monkeypatch):
    """Equal scores are summed before they are dealt, or not; either way as if rows were repeated."""
    monkeypatch.setattr(bootstrap, "TIES", ties)
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 90), "k": rng.integers(0, 2, 90), "c": rng.integers(0, 7, 90).astype(str), "y": rng.integers(0, 2, 90), "s": np.round(rng.standard_normal(90), 1)})
    df = spark.createDataFrame(pdf)
    weights = bootstrap.draw_weights(spark, df.select(F.col("c").alias("cluster")).distinct(), 70).cache()
    held = {r.cluster: np.frombuffer(r.w, np.uint8) for r in weights.collect()}
    assert len(held) == 7 and (sum(held.values()) == 7).all() and len({tuple(v) for v in held.values()}) == 7
    got = {(r.g, r.k, r.b): r.auc for r in bootstrap.replicate_aucs(df, ["g", "k"], "c", "s", "y", weights, 70).collect()}
    for b in range(0, 70, 9):
        for (g, k), rows in pdf.fillna({"g": "none"}).groupby(["g", "k"]):
            many = rows.loc[rows.index.repeat([held[c][b] for c in rows.c])]
            want = plain_auc(many.y, many.s)
            assert got.get((None if g == "none" else g, k, b)) == (want if want is None else pytest.approx(want))


def test_missing_scores_and_labels_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 0, 0.4), ("a", 0, float("nan")), ("b", 1, None), ("a", None, 0.1)], "c string, y int, s double")
    weights = spark.createDataFrame([("a", bytes([1, 0])), ("b", bytes([1, 2]))], "cluster string, w binary")
    assert [tuple(r) for r in bootstrap.replicate_aucs(df, [], "c", "s", "y", weights, 2).collect()] == [(0, 1.0)]
    assert bootstrap.replicate_aucs(df.where("false"), [], "c", "s", "y", weights, 2).collect() == []
    assert bootstrap.draw_weights(spark, df.where("false").select(F.col("c").alias("cluster")), 5).collect() == []


def test_many_clusters(spark):
    """Every cluster may be drawn, and the interval of a known spread comes out, in one plan without pairs of clusters."""
    n, replicates = 20_000, 200
    df = spark.range(2 * n).select((F.col("id") % n).alias("c"), (F.xxhash64("id") % 2 == 0).cast("int").alias("y"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000).alias("s"))
    weights = bootstrap.draw_weights(spark, df.select(F.col("c").alias("cluster")).distinct(), replicates).cache()
    sizes = weights.select(F.length("w").alias("l")).groupBy("l").count().collect()
    assert [(r.l, r["count"]) for r in sizes] == [(replicates, n)]
    one = np.frombuffer(weights.first().w, np.uint8)
    assert 0.6 < one.mean() < 1.5
    found = bootstrap.replicate_aucs(df, [], "c", "s", "y", weights, replicates).toPandas().auc
    # the deviation of an AUC of chance scores is sqrt((n + 1) / (12 p n))
    assert len(found) == replicates and found.std() == pytest.approx(np.sqrt((2 * n + 1) / (12 * n * n)), rel=0.25)
