"""Exact order statistics against numpy."""

import numpy as np
import pandas as pd
import pytest

from plumbline.operators.quantiles import order_statistics, with_order_statistics


@pytest.mark.parametrize("n", [1, 2, 5, 900])
def test_like_linear_quantiles(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", ""], n), "h": rng.integers(0, 2, n), "v": np.round(rng.standard_normal(n) ** 3, 2)})
    pdf.loc[pdf.index % 3 == 0, "v"] = 0.25  # a third of all rows share one value
    shares = [0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 1]
    df = spark.createDataFrame(pdf).repartition(3)
    got = {(r.g, r.h): r.quantiles for r in order_statistics(df, ["g", "h"], "v", shares).collect()}
    want = {k: np.quantile(rows.v, shares).tolist() for k, rows in pdf.groupby(["g", "h"])}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert order_statistics(df, [], "v", [0.5]).first().quantiles == pytest.approx([np.median(pdf.v)])


def test_missing_values_and_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", None), ("x", float("nan")), ("y", 7.0)], "g string, v double")
    found = with_order_statistics(df.groupBy("g").count(), df, ["g"], "v", [0.5, 1.0], ["mid", "top"])
    assert {r.g: (r["count"], r.mid, r.top) for r in found.collect()} == {None: (2, 2.0, 3.0), "x": (2, None, None), "y": (1, 7.0, 7.0)}
    assert order_statistics(df.where("false"), ["g"], "v", [0.5]).collect() == [] == order_statistics(df.where("false"), [], "v", [0.5]).collect()
