"""Distributed fits, detectors and selectors against plain fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import estimators, fitting
from plumbline.operators.fitting import Problem
from tests import plain_learning as learning


def plain_auc(y, s):
    pos, neg = [v for v, k in zip(s, y) if k], [v for v, k in zip(s, y) if not k]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def plain_methods(r, m, v, fold):
    """Scores of the held rows by some of the methods: plain, gated, and with the out-of-fold score of the lookback features."""
    base, local, wide, look = list(range(0, 2)), list(range(2, 8)), list(range(8, 14)), list(range(24, 32))
    linear = lambda a: learning.Linear().fit(a[m], r.y[m]).score(a[v])
    out = {"base": linear(r.x[:, base]), "published": linear(r.x[:, [*range(16, 24), *base]]), "signals": linear(r.x[:, [*local, *wide, *base]])}
    x = r.x[:, [*local, *wide, *base]]
    out["signals, soft prior"] = linear(learning.soft_gated(x, r.gate, slice(0, 6), m))
    out["signals, hard prior"] = learning.hard_gated(x, x, r.y, r.gate, m, r.fold)[v]
    c = learning.tune(r.x[m][:, look], r.y[m], r.fold[m], learning.SHORT_GRID)
    s = np.full(len(r.y), np.nan)
    s[m] = learning.out_of_fold(r.x[m][:, look], r.y[m], r.fold[m], c)
    s[v] = learning.Linear(c).fit(r.x[m][:, look], r.y[m]).score(r.x[v][:, look])
    out["stacked"] = linear(s[:, None])
    whole = np.column_stack([r.x[:, [*local, *wide]], s, r.x[:, base]])
    out["all"] = linear(whole)
    z = (r.gate - r.gate[m].mean()) / r.gate[m].std(ddof=1)
    out["all, soft prior"] = linear(np.column_stack([whole, r.x[:, local] * z[:, None], s * z]))
    return out


def test_linear_meets_its_objective():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((80, 4))
    y = (x[:, 0] + rng.standard_normal(80) > 0.8).astype(int)
    x[3, 1] = np.nan
    m = learning.Linear(0.5).fit(x, y)
    z = np.hstack([(np.where(np.isnan(x), m.middle, x) - m.mean) / m.scale, np.ones((80, 1))])
    weight = np.where(y == 1, 80 / (2 * y.sum()), 80 / (2 * (80 - y.sum())))
    grad = z.T @ (weight * (1 / (1 + np.exp(-z @ m.w)) - y)) + np.append(m.w[:-1], 0) / 0.5
    assert np.abs(grad).max() < 1e-6
    assert learning.auc(y, m.score(x)) == pytest.approx(plain_auc(y, m.score(x)))


def gated(n=240, seed=0):
    rng = np.random.default_rng(seed)
    x, gate = rng.standard_normal((n, 2)), rng.standard_normal(n)
    return x, (np.where(gate > 0, x[:, 0], -x[:, 0]) > 0).astype(int), gate, np.arange(n) % 4


def test_gates():
    x, y, gate, fold = gated()
    train = np.ones(len(y), bool)
    assert learning.auc(y, learning.hard_gated(x, x, y, gate, train, fold)) > 0.85 > learning.auc(y, learning.Linear().fit(x, y).score(x))
    with pytest.raises(ValueError):
        learning.soft_gated(x, np.ones(len(y)), slice(0, 1), train)


def test_hard_gate_rules():
    x, y, gate, fold = gated()
    gate, train = np.round(gate, 1), np.ones(len(gate), bool)
    tau = float(np.median(gate))
    low, high = x[:, :1], x[:, 1:]
    want = np.where(gate >= tau, learning.Linear().fit(high[gate >= tau], y[gate >= tau]).score(high), learning.Linear().fit(low[gate < tau], y[gate < tau]).score(low))
    assert (gate == tau).any() and np.allclose(learning.experts(tau, low, high, y, gate, train), want)  # equal goes high
    aucs = np.array([[0.9, 0.6, 0.7], [np.nan, 0.6, 0.6]])
    assert learning.chosen_threshold(aucs, gate) == np.quantile(gate, learning.QUANTILES[2])  # a failing fold rules out
    with pytest.raises(ValueError):
        learning.chosen_threshold(np.full((2, 3), np.nan), gate)
    assert learning.experts(float(np.sort(gate)[5]), x, x, y, gate, train) is None


@pytest.fixture
def small_block(spark, monkeypatch):
    """Two runs with a component that tells the label in either half of the block."""
    from plumbline.plans import learning as plans

    rng = np.random.default_rng(0)
    rows = []
    for run in ("first", "second"):
        for i in range(240):
            x = [float(v) for v in rng.standard_normal(32)]
            x[15], x[31] = i % 2 * 1.5 + rng.standard_normal(), i % 2 * 1.5 + rng.standard_normal()
            rows.append((run, x, i, f"s{i // 2 % 20}", i % 2, i // 2 % 5, i // 2 % 20 > 14, float(rng.random()), 1000 + i % 3 * 900))
    df = spark.createDataFrame(rows, "run string, x array<double>, doc_id bigint, source string, label int, fold bigint, test boolean, gate double, n_chars bigint")
    monkeypatch.setattr(plans, "block", lambda *_: df)
    pdf = df.toPandas()
    return plans, {k: learning.Rows(g) for k, g in pdf.groupby("run")}


def test_detector_queries_against_plain_fits(spark, small_block):
    plans, runs = small_block
    got = {n: {k: g.sort_values("doc_id").score.to_numpy() for k, g in getattr(plans, n)(spark, "").toPandas().groupby("run")} for n in ("logreg_detector", "oof_scores", "soft_gate", "hard_gate")}
    for run, r in runs.items():
        t, x, y = r.train, r.x, r.y
        c = learning.tune(x[t], y[t], r.fold[t])
        assert np.allclose(got["logreg_detector"][run], learning.Linear(c).fit(x[t], y[t]).score(x), atol=2e-6)
        c = learning.tune(x[t], y[t], r.fold[t], learning.SHORT_GRID)
        want = learning.Linear(c).fit(x[t], y[t]).score(x)
        want[t] = learning.out_of_fold(x[t], y[t], r.fold[t], c)
        assert np.allclose(got["oof_scores"][run], want, atol=2e-6)
        wide = learning.soft_gated(x, r.gate, slice(None), t)
        assert np.allclose(got["soft_gate"][run], learning.Linear().fit(wide[t], y[t]).score(wide), atol=2e-6)
        assert np.allclose(got["hard_gate"][run], learning.hard_gated(x[:, :16], x[:, 16:], y, r.gate, t, r.fold), atol=2e-6)
        assert all(learning.auc(y[~t], s[run][~t]) > 0.75 for s in got.values())


def test_fold_tables_and_selector(spark, small_block):
    plans, runs = small_block
    table = plans.dev_cv(spark, "").toPandas()
    summary = plans.method_summary(spark, "").toPandas().set_index(["run", "method"])
    picked = plans.redeep_selector(spark, "").toPandas().set_index("run")
    report = plans.probability_report(spark, "").toPandas().set_index("run")
    assert len(table) == 2 * plans.FOLDS * len(plans.METHODS)
    for run, r in runs.items():
        own = table[table.run == run]
        for f in range(plans.FOLDS):
            m, v = r.train & (r.fold != f), r.train & (r.fold == f)
            want = plain_methods(r, m, v, f)
            for name, scores in want.items():
                assert own[(own.method == name) & (own.fold == f)].auc.iloc[0] == pytest.approx(learning.auc(r.y[v], scores), abs=2e-6)
        plain = own[own.method == "published"].auc
        line = summary.loc[(run, "published")]
        assert line["mean"] == pytest.approx(plain.mean(), abs=2e-6) and line["sd"] == pytest.approx(plain.std(ddof=0), abs=2e-6) and line["better"] == 0
        best = (-1.0, None)
        for n, m, b in plans.SETTINGS:
            if n <= 24:
                total = 0.0
                for f in range(plans.FOLDS):
                    fit, v = r.train & (r.fold != f), r.train & (r.fold == f)
                    r_of = lambda z: np.corrcoef(np.column_stack([z[fit], r.y[fit]]).T)[-1, :-1]  # noqa: B023, E731
                    e, p = np.argsort(r_of(r.x[:, :24]), kind="stable")[:n], np.argsort(-r_of(r.x[:, 24:]), kind="stable")[:m]
                    es, ps = r.x[v][:, e].sum(1), r.x[v][:, 24 + p].sum(1)
                    total += learning.auc(r.y[v], -es if np.isinf(b) else ps - b * es)
                if total > best[0] + 1e-9:
                    best = (total, (n, m, b))
        assert tuple(picked.loc[run][["n", "m", "beta"]]) == best[1]
        t = r.train
        p = learning.Linear(learning.tune(r.x[t], r.y[t], r.fold[t])).fit(r.x[t], r.y[t]).score(r.x[~t])
        assert report.loc[run].auc == pytest.approx(learning.auc(r.y[~t], p), abs=2e-6) and report.loc[run].ap == pytest.approx(learning.precision(r.y[~t], p), abs=2e-6)
    moved = plans.transfer(spark, "").toPandas().set_index("variant")
    assert set(moved.index) == {"first", "second"} and moved.n_train.nunique() == 1 and moved.loc["first"].auc > 0.7
    seeds = plans.oof_robustness(spark, "").toPandas()
    assert len(seeds) == len(plans.SEEDS) and (seeds["first"] > 0.75).all() and np.allclose(seeds.gap, seeds.second - seeds["first"], atol=3e-6)


def frame(spark, n=300, seed=1, missing=True):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 4)) * [1, 5, 0.1, 1] + [0, 1000, 0, 0]
    y = (x[:, 0] + rng.standard_normal(n) > 0.5).astype(int)
    if missing:
        x[rng.random((n, 4)) < 0.1] = np.nan
    x[:, 3] = np.nan_to_num(x[:, 3])
    fold = np.arange(n) % 4
    return x, y, fold, spark.createDataFrame([("r", v.tolist(), int(k), int(f), i) for i, (v, k, f) in enumerate(zip(x, y, fold, strict=True))], "run string, x array<double>, label int, fold long, i long").repartition(5)


def test_fit_equals_the_plain_one_with_missing_values(spark):
    x, y, fold, df = frame(spark)
    some = [Problem("r", f"{f}/{c}", c, (f,)) for f in range(4) for c in (0.01, 1.0, 10.0)] + [Problem("r", "part", columns=(2, 0)), Problem("r", "soft", gate=3, gated=(0, 1), columns=(0, 1))]
    fits = fitting.fit(df, some)
    for f in fits:
        p = f.problem
        m = ~np.isin(fold, p.held)
        own = np.where(np.isnan(x), np.nanmedian(x[m], 0), x)
        z = own if p.columns is None else own[:, p.columns]
        z = np.column_stack([z, own[:, [0, 1]] * ((own[:, 3] - own[m][:, 3].mean()) / own[m][:, 3].std(ddof=1))[:, None]]) if p.gated else z
        assert np.allclose(f.scores(x), learning.Linear(p.c).fit(z[m], y[m]).score(z), atol=1e-6)
    held = fitting.scored(df, fits[:12], ("i",), held=True).toPandas()
    assert len(held) == 300 * 3 and (held["i"] % 4 == held["name"].str[0].astype(int)).all()


def test_fit_of_one_class_and_constant_gate(spark):
    _, _, _, df = frame(spark, 40)
    one = df.withColumn("label", F.lit(1))
    assert not fitting.fit(one, [Problem("r", "a")])[0].usable
    flat = df.withColumn("x", F.array(F.get("x", F.lit(0)), F.lit(2.0)))
    assert not fitting.fit(flat, [Problem("r", "a", gate=1, gated=(0,))])[0].usable
    assert fitting.scored(one, fitting.fit(one, [Problem("r", "a"), Problem("none", "b")]), ("i",)).collect() == []
    with pytest.raises(ValueError, match="both classes"):
        estimators.LinearDetector().fit(one)


def test_estimators_are_kept_and_read_back(spark, tmp_path):
    x, y, fold, df = frame(spark)
    soft = estimators.LinearDetector(grid=[0.01, 1.0], columns=[0, 1, 2], gate=3, gated=[0], predictionCol="told")
    hard = estimators.GatedExperts(gate=3, low=[0, 1], columns=[2, 0])
    for n, (e, kind) in enumerate(((soft, estimators.LinearDetector), (hard, estimators.GatedExperts))):
        e.write().save(f"{tmp_path}/e{n}")
        again = kind.load(f"{tmp_path}/e{n}")
        assert {p.name: v for p, v in again.extractParamMap().items()} == {p.name: v for p, v in e.extractParamMap().items()}
        model = again.fit(df)
        model.write().save(f"{tmp_path}/m{n}")
        back = estimators.LinearDetectorModel.load(f"{tmp_path}/m{n}")
        name = model.getPredictionCol()
        a, b = (m.transform(df).orderBy("i").toPandas()[name].to_numpy() for m in (model, back))
        assert np.array_equal(a, b) and learning.auc(y, a) > 0.7
    own = np.where(np.isnan(x), np.nanmedian(x, 0), x)
    want = learning.hard_gated(own[:, [0, 1]], own[:, [2, 0]], y, x[:, 3], np.ones(len(y), bool), fold)
    assert np.allclose(a, want, atol=1e-6)
