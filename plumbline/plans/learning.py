"""Trained detectors; SQL cannot express the fits, so tests hold them against plain versions.

Every fit goes through ``operators.fitting``: all folds, strengths and methods of all runs are problems of a few joint
passes over the rows, and what the folds tell is an AUC by groups. No task holds a run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import rounded
from plumbline.operators import estimators
from plumbline.operators.estimators import GRID, LEAST, QUANTILES, SHORT_GRID, best_strengths, fold_aucs
from plumbline.operators.fitting import Fitted, Problem, fit, scored
from plumbline.operators.lineage import written
from plumbline.operators.metrics import auc, average_precision
from plumbline.operators.quantiles import order_statistics
from plumbline.operators.sampling import hash_order, random_folds
from plumbline.plans.assembly import base
from plumbline.plans.registry import query

FOLDS = 5
#: Places in a row's features: 32 of the block, then how long the text is, as a gate, and how much of it a window holds.
X, GATE, COVERAGE = tuple(range(32)), 32, 33
ROW = ("doc_id", "label", "test")


def block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two runs, one per half of the feature block, with gate, grouped fold and split."""
    df = base(spark, sf_dir)
    test = F.conv(F.substring(hash_order(1, F.col("source")), 1, 4), 16, 10).cast("int") % 4 == 0
    x = F.col("x").cast("array<double>")
    runs = F.explode(F.array(*[F.struct(F.lit(n).alias("run"), F.slice(x, at, 32).alias("x")) for n, at in (("first", 1), ("second", 33))])).alias("r")
    rows = df.join(random_folds(df, "source", FOLDS, 11), "source").select(runs, "doc_id", "source", "label", "fold", test.alias("test"), F.log1p("n_chars").alias("gate"), "n_chars")
    return rows.select("r.run", "r.x", "doc_id", "source", "label", "fold", "test", "gate", "n_chars")


def ready(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The rows, written, with gate and coverage behind the features, and the runs, a name each."""
    cover = F.least("n_chars", F.lit(2000)) / F.col("n_chars")
    rows = written(block(spark, sf_dir).withColumn("x", F.concat("x", F.array(F.col("gate").cast("double"), cover.cast("double")))))
    return rows, [r["run"] for r in rows.select("run").distinct().orderBy("run").collect()]


def train_of(rows: DataFrame) -> DataFrame:
    return rows.where("not test").drop("test")


def by_folds(runs: list[str], **more) -> list[Problem]:
    return [Problem(r, str(f), held=(f,), columns=X, **more) for r in runs for f in range(FOLDS)]


def tuned(rows: DataFrame, runs: list[str], grid: tuple[float, ...]) -> tuple[list[Fitted], list[Fitted], dict[str, float]]:
    """Detectors of all training rows with the strengths that the folds choose, those of the folds with these strengths, and the strengths by run."""
    train = train_of(rows)
    every = [Problem(p.run, f"{p.held[0]}/{i}", c, p.held, X) for p in by_folds(runs) for i, c in enumerate(grid)]
    inner = fit(train, every)
    told = fold_aucs(train, inner)
    best = best_strengths(told, runs, range(FOLDS), grid)
    return fit(train, [Problem(r, "all", best[r], columns=X) for r in runs]), [f for f in inner if f.problem.c == best[f.problem.run]], best


def shown(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """All rows with what scores there are; a run that can't be fit has none, and leaves the others theirs."""
    own = rows.select("run", *ROW).join(scores.select("run", "doc_id", "score"), ["run", "doc_id"], "left")
    return own.select("run", "doc_id", F.col("label").cast("long").alias("label"), "test", rounded(F.nanvl("score", F.lit(None).cast("double"))).alias("score"))


@query()
def logreg_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength by grouped cross-validation on the training sources, one fit, scores of all rows."""
    rows, runs = ready(spark, sf_dir)
    return shown(rows, scored(rows, tuned(rows, runs, GRID)[0], ROW))


@query()
def oof_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows by detectors that saw no row of their fold, the others by a detector of all training rows; one strength, chosen by the folds."""
    rows, runs = ready(spark, sf_dir)
    whole, inner, _ = tuned(rows, runs, SHORT_GRID)
    usable = {f.problem.run for f in whole if f.usable}
    own = scored(rows.where("not test"), [f for f in inner if f.problem.run in usable], ROW, held=True)
    return shown(rows, own.unionByName(scored(rows.where("test"), whole, ROW)))


@query()
def soft_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detector over the features and the features times the standardised gate."""
    rows, runs = ready(spark, sf_dir)
    return shown(rows, scored(rows, fit(train_of(rows), [Problem(r, "all", columns=X, gate=GATE, gated=X) for r in runs]), ROW))


def gate_quantiles(rows: DataFrame, gates: dict[str, int]) -> dict[tuple[str, str], list[float]]:
    """Per run and gate the quantiles that are tried as thresholds, exact."""
    each = rows.select("run", F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.get("x", F.lit(at)).alias("v")) for n, at in gates.items()])).alias("g"))
    return {(r["run"], r["gate"]): r["q"] for r in order_statistics(each.select("run", "g.gate", "g.v"), ["run", "gate"], "v", list(QUANTILES), "q").collect()}


def sides(run: str, name: str, held: tuple[int, ...], low: tuple[int, ...], high: tuple[int, ...], tau: float, gate: int = GATE) -> list[Problem]:
    """Two experts, one over the features ``low`` below the threshold, one over ``high`` from it on."""
    return [Problem(run, name, held=held, columns=low, gate=gate, side=(-np.inf, tau)), Problem(run, name, held=held, columns=high, gate=gate, side=(tau, np.inf))]


def whole_pairs(fits: list[Fitted]) -> list[Fitted]:
    """Experts both of whose sides have rows enough and both classes."""
    bad = {(f.problem.run, f.problem.name) for f in fits if not f.usable or f.n < LEAST}
    return [f for f in fits if (f.problem.run, f.problem.name) not in bad]


def best_quantile(told: dict[tuple[str, str], float], run: str, names: list[list[str]]) -> int | None:
    """The quantile with the best mean over its folds' names, the first of equals; a fold without a value rules it out."""
    means = [float(np.mean([told[run, n] for n in own])) if all((run, n) in told for n in own) else None for own in names]
    some = [m for m in means if m is not None]
    return means.index(max(some)) if some else None


@query()
def hard_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two detectors, each over its own half of the features, parted by a quantile of the gate that the folds choose."""
    rows, runs = ready(spark, sf_dir)
    train, low, high = train_of(rows), X[:16], X[16:]
    cuts = gate_quantiles(train, {"gate": GATE})
    tried = [p for r in runs if (r, "gate") in cuts for q, tau in enumerate(cuts[r, "gate"]) for f in range(FOLDS) for p in sides(r, f"{q}/{f}", (f,), low, high, tau)]
    told = fold_aucs(train, whole_pairs(fit(train, tried)))
    best = {r: best_quantile(told, r, [[f"{q}/{f}" for f in range(FOLDS)] for q in range(len(QUANTILES))]) for r in runs}
    final = [p for r in runs if best[r] is not None for p in sides(r, "all", (), low, high, cuts[r, "gate"][best[r]])]
    return shown(rows, scored(rows, whole_pairs(fit(train, final)), ROW))


def correlations(rows: DataFrame) -> DataFrame:
    """(run, held, j, r): correlation of each feature with the label over the rows outside each fold, from five sums by fold."""
    each = rows.select("run", "fold", F.col("label").cast("double").alias("y"), F.posexplode(F.slice("x", 1, len(X))).alias("j", "v")).where("v is not null and not isnan(v)")
    total = lambda c: F.sum(c)
    sums = each.groupBy("run", "fold", "j").agg(F.count(F.lit(1)).alias("n"), total("v").alias("a"), total("y").alias("b"), total(F.col("v") * F.col("v")).alias("aa"), total(F.col("y") * F.col("y")).alias("bb"), total(F.col("v") * F.col("y")).alias("ab"))
    held = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FOLDS - 1).cast("long"))).alias("held")
    rest = sums.select("*", held).where("fold <> held").groupBy("run", "held", "j").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")])
    spread = lambda s, q: F.greatest(F.col(q) - F.col(s) * F.col(s) / F.col("n"), F.lit(0.0))
    r = (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.sqrt(spread("a", "aa") * spread("b", "bb"))
    return rest.select("run", "held", "j", F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)).alias("r"))


@query()
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inside each fold the ten components that correlate most with the label, then a detector on these."""
    rows, _ = ready(spark, sf_dir)
    first = F.sort_array(F.collect_list(F.struct((-F.abs("r")).alias("r"), "j")))
    tops = correlations(rows).groupBy("run", "held").agg(F.transform(F.slice(first, 1, 10), lambda x: x["j"]).alias("top")).collect()  # a row per run and fold
    fits = fit(rows, [Problem(t["run"], str(t["held"]), held=(t["held"],), columns=tuple(t["top"])) for t in tops])
    return shown(rows, scored(rows, fits, ROW, held=True))


@query()
def probability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC and average precision of the tuned detector's probabilities on the test rows; NULL with one class on a side or fewer than ten training rows."""
    rows, runs = ready(spark, sf_dir)
    asked = written(scored(rows.where("test"), tuned(rows, runs, GRID)[0], ROW).withColumn("p", 1 / (1 + F.exp(-F.col("score")))))
    about = rows.groupBy("run").agg(F.count_if(~F.col("test")).alias("n_train"), F.count_if("test").alias("n_test"), F.count_if(F.col("test") & (F.col("label") == 1)).alias("_pos"))
    found = about.join(auc(asked, ["run"], "p", "label").select("run", "auc"), "run", "left").join(average_precision(asked, ["run"], "p", "label"), "run", "left")
    fine = (F.col("n_train") >= 10) & (F.col("_pos") > 0) & (F.col("_pos") < F.col("n_test"))
    return found.select("run", "n_train", "n_test", *[F.when(fine, rounded(F.col(c))).alias(c) for c in ("auc", "ap")])


@dataclass(frozen=True)
class Method:
    """A detector by what it reads: features by place, ``stacked`` the out-of-fold score of the lookback features; a soft gate multiplies ``gated``, a hard one parts ``low`` and ``columns``."""

    columns: tuple[int, ...]
    gate: int | None = None
    gated: tuple[int, ...] = ()
    low: tuple[int, ...] | None = None
    stacked: bool = False

    def problems(self, run: str, name: str, held: tuple[int, ...], s: int, tau: float | None = None) -> list[Problem]:
        """``s``: the place of the stacked score, which stands for STACK."""
        at = lambda places: tuple(s if p == STACK else p for p in places)
        if self.low is None:
            return [Problem(run, name, held=held, columns=at(self.columns), gate=self.gate, gated=at(self.gated))]
        return sides(run, name, held, at(self.low), at(self.columns), tau, self.gate)


STACK = -1
BASE, LOCAL, WIDE, PLACE, PUBLISHED, LOOKBACK = X[0:2], X[2:8], X[8:14], X[14:16], X[16:24], X[24:32]
ALL = (*LOCAL, *WIDE, STACK, *BASE)
#: Thirteen methods by name: plain ones, controls, and gates by the prior (hard or soft) and by coverage.
METHODS = {
    "base": Method(BASE),
    "published": Method((*PUBLISHED, *BASE)),
    "signals": Method((*LOCAL, *WIDE, *BASE)),
    "signals, soft prior": Method((*LOCAL, *WIDE, *BASE), GATE, LOCAL),
    "signals, hard prior": Method((*LOCAL, *WIDE, *BASE), GATE, low=(*LOCAL, *WIDE, *BASE)),
    "position": Method((*PLACE, *BASE)),
    "stacked": Method((STACK,), stacked=True),
    "stacked, position": Method((STACK, *PLACE, *BASE), stacked=True),
    "all": Method(ALL, stacked=True),
    "all, soft prior": Method(ALL, GATE, (*LOCAL, STACK), stacked=True),
    "all, soft coverage": Method((*ALL, COVERAGE), COVERAGE, (*LOCAL, STACK), stacked=True),
    "parts, hard prior": Method((STACK, *WIDE, *BASE), GATE, low=(*LOCAL, *BASE), stacked=True),
    "all, hard prior": Method(ALL, GATE, low=ALL, stacked=True),
}


def stacked(train: DataFrame, runs: list[str]) -> DataFrame:
    """The training rows with FOLDS more features: place len(x) + f holds the lookback score that a fit without fold f gives. Rows outside f have it from a fit that also left out their own fold; the strength is chosen inside."""
    pairs = [(r, o, i) for r in runs for o in range(FOLDS) for i in range(FOLDS) if i != o]
    inner = fit(train, [Problem(r, f"{o}/{i}/{k}", c, (o, i), LOOKBACK) for r, o, i in pairs for k, c in enumerate(SHORT_GRID)])
    told = fold_aucs(train, inner)
    best = {}
    for r in runs:
        for o in range(FOLDS):
            seen = np.array([[told.get((r, f"{o}/{i}/{k}"), np.nan) for k in range(len(SHORT_GRID))] for i in range(FOLDS) if i != o])
            best[r, o] = estimators.best_of(seen)
    own = [f for f in inner if f.problem.name.endswith(f"/{best[f.problem.run, f.problem.held[0]]}")]
    outer = fit(train, [Problem(r, f"{o}/{o}", SHORT_GRID[best[r, o]], (o,), LOOKBACK) for r in runs for o in range(FOLDS)])
    scores = scored(train, own + outer, ("doc_id",), held=True).select("run", "doc_id", F.split("name", "/")[0].cast("int").alias("o"), "score")
    wide = scores.groupBy("run", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("o", "score"))).alias("s"))
    more = F.array(*[F.element_at("s", F.lit(o)) for o in range(FOLDS)])
    return written(train.join(wide, ["run", "doc_id"], "left").withColumn("x", F.concat("x", more)).drop("s"))


def method_folds(rows: DataFrame, runs: list[str]) -> DataFrame:
    """(run, method, fold, auc): every method on every held-out fold of the training rows; a method that can't be fit has NULL."""
    train = stacked(train_of(rows), runs)
    spark, first = rows.sparkSession, COVERAGE + 1
    hard = {n: m for n, m in METHODS.items() if m.low is not None}
    cuts = {}
    for f in range(FOLDS):  # thresholds come from the rows that the fold leaves
        cuts |= {(r, f): q for (r, _), q in gate_quantiles(train.where(F.col("fold") != f), {"gate": GATE}).items()}
    inner = [
        p for n, m in hard.items() for (r, f), taus in cuts.items() for q, tau in enumerate(taus) for i in range(FOLDS) if i != f
        for p in m.problems(r, f"{n}/{f}/{q}/{i}", (f, i), first + f, tau)
    ]
    told = fold_aucs(train, whole_pairs(fit(train, inner)))
    problems = [p for n, m in METHODS.items() if m.low is None for r in runs for f in range(FOLDS) for p in m.problems(r, f"{n}/{f}", (f,), first + f)]
    for n, m in hard.items():
        for (r, f), taus in cuts.items():
            best = best_quantile(told, r, [[f"{n}/{f}/{q}/{i}" for i in range(FOLDS) if i != f] for q in range(len(QUANTILES))])
            if best is not None:
                problems += m.problems(r, f"{n}/{f}", (f,), first + f, taus[best])
    fits = fit(train, problems)
    fine = [f for f in fits if f.problem.side == (-np.inf, np.inf)] + whole_pairs([f for f in fits if f.problem.side != (-np.inf, np.inf)])
    found = auc(scored(train, fine, ("label",), held=True), ["run", "name"], "score", "label")
    every = spark.createDataFrame([(r, n, f, f"{n}/{f}") for r in runs for n in METHODS for f in range(FOLDS)], "run string, method string, fold bigint, name string")
    return every.join(found, ["run", "name"], "left").select("run", "method", "fold", "auc")


@query()
def dev_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of methods by folds."""
    return method_folds(*ready(spark, sf_dir)).withColumn("auc", rounded(F.col("auc")))


@query()
def method_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation over the folds, and in how many folds a method is better than the published one."""
    told = written(method_folds(*ready(spark, sf_dir)))
    plain = told.where("method = 'published'").select("run", "fold", F.col("auc").alias("p"))
    both = told.join(plain, ["run", "fold"])
    return both.groupBy("run", "method").agg(rounded(F.avg("auc")).alias("mean"), rounded(F.stddev_pop("auc")).alias("sd"), F.count("auc").alias("n_folds"), F.count_if(F.col("auc") > F.col("p")).alias("better"))


# The settings of a score of ranked components, how many context heads, how many layers, weight of the context part.
HEADS, LAYERS, BETAS = (1, 2, 4, 8, 16, 32), (1, 2, 3, 5, 8), (0.0, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, float("inf"))
#: 24 components stand for context heads, 8 for layers.
CONTEXT = 24
SETTINGS = tuple((n, m, b) for n in HEADS if n <= CONTEXT for m in LAYERS for b in BETAS)


def setting_weights(r: np.ndarray) -> np.ndarray:
    """(features, settings): what each setting weighs each component by, so that one product scores all settings. Heads count by rising, layers by falling correlation ``r``; an infinite weight leaves the context alone."""
    heads, layers = np.argsort(np.argsort(r[:CONTEXT], kind="stable")), np.argsort(np.argsort(-r[CONTEXT:], kind="stable"))
    out = np.zeros((len(r), len(SETTINGS)))
    for k, (n, m, beta) in enumerate(SETTINGS):
        out[:CONTEXT, k] = (heads < n) * (-1.0 if np.isinf(beta) else -beta)
        out[CONTEXT:, k] = (layers < m) * (0.0 if np.isinf(beta) else 1.0)
    return out


def by_settings(rows: DataFrame, weights: dict[tuple[str, int], np.ndarray], which: dict[str, int] | None = None) -> DataFrame:
    """(run, held, setting, score, label): rows by the weights of their run and fold, or, with one chosen setting per run (``which``), by the weights of fold -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, fold, y = b.column("run").to_pylist(), b.column("fold").to_numpy(), b.column("label").to_numpy()
            x = np.array([v[: len(X)] for v in b.column("x").to_pylist()], float).reshape(-1, len(X))
            for (r, held), w in weights.items():
                at = np.flatnonzero([n == r and (which is not None or f == held) for n, f in zip(names, fold, strict=True)])
                if len(at):
                    ks = np.arange(len(SETTINGS)) if which is None else np.array([which[r]])
                    s = x[at] @ w[:, ks]
                    yield pa.record_batch([pa.array([r] * s.size), pa.array(np.full(s.size, held)), pa.array(np.tile(ks, len(at))), pa.array(s.ravel()), pa.array(np.repeat(y[at], len(ks)).astype(np.int32))], names=["run", "held", "setting", "score", "label"])

    return rows.select("run", "fold", "x", "label").mapInArrow(run, "run string, held bigint, setting bigint, score double, label int")


@query()
def redeep_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads, layers and weight of a ranked score by inner folds, each with ranks of its own training rows; then ranks of all training rows, and the AUC on the others."""
    rows, runs = ready(spark, sf_dir)
    train = train_of(rows)

    def ranks(told: DataFrame) -> dict[tuple[str, int], np.ndarray]:
        """Per run and fold the correlations in the order of features: as many numbers as there are features."""
        some = told.groupBy("run", "held").agg(F.sort_array(F.collect_list(F.struct("j", "r"))).alias("c")).collect()
        return {(r["run"], r["held"]): setting_weights(np.array([c["r"] for c in r["c"]])) for r in some}

    inner = auc(by_settings(train, ranks(correlations(train))), ["run", "held", "setting"], "score", "label")
    # a setting counts by its sum over the folds, one without a value in any fold is out
    sums = inner.groupBy("run", "setting").agg(F.sum("auc").alias("s"), F.count_if(F.col("auc").isNull()).alias("missing")).where("missing = 0")
    best = {r["run"]: -r["b"]["k"] for r in sums.groupBy("run").agg(F.max(F.struct(F.round("s", 9).alias("s"), (-F.col("setting")).alias("k"))).alias("b")).collect()}
    whole = ranks(correlations(train.withColumn("fold", F.lit(-1).cast("long"))).where("held = 0").withColumn("held", F.lit(-1)))
    found = auc(by_settings(rows.where("test"), {k: w for k, w in whole.items() if k[0] in best}, best), ["run", "setting"], "score", "label")
    chosen = spark.createDataFrame([(r, k, *map(float, SETTINGS[k])) for r, k in best.items()], "run string, setting bigint, n double, m double, beta double")
    return chosen.join(found, ["run", "setting"], "left").select("run", F.col("n").cast("long").alias("n"), F.col("m").cast("long").alias("m"), "beta", rounded(F.col("auc")).alias("auc"))


@query()
def transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fixed detector, trained on the first block of rows that fit the window, applied to longer rows with either block read in its place; training sources that the longer rows share are dropped first."""
    rows, _ = ready(spark, sf_dir)
    asked = rows.where("test and n_chars > 2000").withColumn("variant", F.col("run")).withColumn("run", F.lit("first"))
    seen = rows.where("run = 'first' and n_chars <= 2000")
    own = written(seen.join(asked.select("source").distinct(), "source", "left_anti").withColumn("test", F.lit(False)))
    whole, _, _ = tuned(own, ["first"], SHORT_GRID)
    found = auc(scored(asked, whole, ("variant", "label")), ["variant"], "score", "label").select("variant", "auc")
    sizes = asked.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).crossJoin(own.agg(F.count(F.lit(1)).alias("n_train")))  # a single row
    return sizes.join(found, "variant", "left").select("variant", "n_train", "n", rounded(F.col("auc")).alias("auc"))


SEEDS = (1, 2, 3, 4, 5)


@query()
def oof_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same out-of-fold AUC under several seeded groupings of the sources; run and seed together are a run of their own."""
    rows, runs = ready(spark, sf_dir)
    rows = rows.drop("fold")
    sources = rows.select("source").distinct()
    folds = None
    for seed in SEEDS:
        some = random_folds(sources, "source", FOLDS, seed).withColumn("seed", F.lit(seed))
        folds = some if folds is None else folds.unionByName(some)
    each = written(rows.join(folds, "source").withColumn("name_", F.col("run")).withColumn("run", F.concat_ws("/", "run", F.col("seed").cast("string"))))
    fits = fit(each, by_folds([f"{r}/{s}" for r in runs for s in SEEDS]))
    out = scored(each, fits, ("name_", "seed", "label"), held=True)
    found = auc(out, ["name_", "seed"], "score", "label").groupBy("seed").pivot("name_", ["first", "second"]).agg(F.first("auc"))
    gap = F.col("second") - F.col("first")
    every = Window.partitionBy()  # one row per seed
    return found.select(F.col("seed").cast("long").alias("seed"), rounded(F.col("first")).alias("first"), rounded(F.col("second")).alias("second"), rounded(gap).alias("gap"), F.sum((gap > 0).cast("int")).over(every).alias("n_above"), rounded(F.min(gap).over(every)).alias("low"), rounded(F.max(gap).over(every)).alias("high"))
