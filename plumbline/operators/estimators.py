"""Detectors as ``pyspark.ml`` estimators and models: fitted by ``operators.fitting``, kept and read back by their params."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.fitting import Fitted, Problem, fit, scored
from plumbline.operators.lineage import written
from plumbline.operators.metrics import auc
from plumbline.operators.quantiles import order_statistics

# Strengths tried by grouped cross-validation, quantiles of a gate tried as thresholds of two experts, and the rows each side must have.
GRID = tuple(10.0 ** (-4 + i / 2) for i in range(11))
SHORT_GRID = tuple(10.0 ** (-4 + i) for i in range(5))
QUANTILES, LEAST = (0.33, 0.5, 0.67), 20


def best_of(aucs: np.ndarray) -> int:
    """The column with the best mean over rows, missing values left out, the first of equals; the first where all are missing."""
    seen = ~np.isnan(aucs)
    means = np.where(seen.any(0), np.where(seen, aucs, 0).sum(0) / np.maximum(seen.sum(0), 1), -1.0)
    return int(np.argmax(means))


def fold_aucs(rows: DataFrame, fits: list[Fitted]) -> dict[tuple[str, str], float]:
    """AUC by run and name over the fold each fit left out last; without the ones that can't be told."""
    found = auc(scored(rows, fits, ("label",), held=True), ["run", "name"], "score", "label")
    return {(r["run"], r["name"]): r["auc"] for r in found.where("auc is not null").collect()}  # a number per fit


def best_strengths(told: dict[tuple[str, str], float], runs: Iterable[str], folds: Iterable[int], grid: tuple[float, ...]) -> dict[str, float]:
    """Per run the strength of the best mean AUC over the folds, where fits are named fold/place in the grid."""
    folds = list(folds)
    return {r: grid[best_of(np.array([[told.get((r, f"{f}/{i}"), np.nan) for i in range(len(grid))] for f in folds]))] for r in runs}


class _Detector(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """``featuresCol`` is an array of numbers, missing ones allowed; ``foldCol`` groups rows for the choice of strength or threshold; ``columns`` are the places read (all, if empty)."""

    foldCol = Param(Params._dummy(), "foldCol", "fold of each row, whole numbers", TypeConverters.toString)
    columns = Param(Params._dummy(), "columns", "places of the features that are read", TypeConverters.toListInt)
    gate = Param(Params._dummy(), "gate", "place of the gate, -1 for none", TypeConverters.toInt)
    gated = Param(Params._dummy(), "gated", "places that also enter times the standardised gate", TypeConverters.toListInt)
    grid = Param(Params._dummy(), "grid", "strengths to choose from by the folds; a single one is taken", TypeConverters.toListFloat)
    low = Param(Params._dummy(), "low", "places that the expert below the threshold reads", TypeConverters.toListInt)
    quantiles = Param(Params._dummy(), "quantiles", "quantiles of the gate tried as the threshold", TypeConverters.toListFloat)

    def _defaults(self) -> None:
        self._setDefault(featuresCol="x", labelCol="label", predictionCol="score", foldCol="fold", columns=[], gate=-1, gated=[], grid=[1.0], low=[], quantiles=list(QUANTILES))

    def _get(self, name: str):
        return self.getOrDefault(name)

    def _rows(self, df: DataFrame) -> DataFrame:
        fold = F.col(self._get("foldCol")) if self._get("foldCol") in df.columns else F.lit(0)
        return written(df.select(F.lit("").alias("run"), F.col(self._get("featuresCol")).cast("array<double>").alias("x"), F.col(self._get("labelCol")).cast("int").alias("label"), fold.cast("long").alias("fold")))


class LinearDetector(Estimator, _Detector, DefaultParamsReadable, DefaultParamsWritable):
    """Medians, standardisation and a class-balanced logistic regression, with a soft gate where ``gated`` is set. Rows of one class, or a constant gate, are an error."""

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, predictionCol=None, foldCol=None, columns=None, gate=None, gated=None, grid=None):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _problem(self, name: str, c: float, held: tuple[int, ...] = ()) -> Problem:
        gate = self._get("gate")
        return Problem("", name, c, held, tuple(self._get("columns")) or None, None if gate < 0 else gate, tuple(self._get("gated")))

    def _fit(self, df: DataFrame) -> LinearDetectorModel:
        rows, grid = self._rows(df), tuple(self._get("grid"))
        c = grid[0]
        if len(grid) > 1:
            folds = [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]
            told = fold_aucs(rows, fit(rows, [self._problem(f"{f}/{i}", c, (f,)) for f in folds for i, c in enumerate(grid)]))
            c = best_strengths(told, [""], folds, grid)[""]
        (found,) = fit(rows, [self._problem("all", c)])
        if not found.usable or found.w is None:
            raise ValueError("a detector needs rows of both classes, and a gate that varies")
        return LinearDetectorModel._of(self, [found], None)


class GatedExperts(Estimator, _Detector, DefaultParamsReadable, DefaultParamsWritable):
    """Two linear detectors, over ``low`` below a threshold of the gate and over ``columns`` from it on; the folds choose the quantile."""

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, predictionCol=None, foldCol=None, columns=None, gate=None, low=None, quantiles=None):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _pair(self, name: str, tau: float, held: tuple[int, ...] = ()) -> list[Problem]:
        low, high = (tuple(self._get(c)) or None for c in ("low", "columns"))
        return [Problem("", name, 1.0, held, low, self._get("gate"), side=(-np.inf, tau)), Problem("", name, 1.0, held, high, self._get("gate"), side=(tau, np.inf))]

    def _fit(self, df: DataFrame) -> LinearDetectorModel:
        rows = self._rows(df)
        folds = [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]
        taus = order_statistics(rows.select(F.get("x", F.lit(self._get("gate"))).alias("v")), [], "v", self._get("quantiles"), "q").first()["q"]
        fits = fit(rows, [p for q, tau in enumerate(taus) for f in folds for p in self._pair(f"{q}/{f}", tau, (f,))])
        small = {f.problem.name for f in fits if not f.usable or f.n < LEAST}
        told = fold_aucs(rows, [f for f in fits if f.problem.name not in small])
        means = [np.mean([told[("", f"{q}/{f}")] for f in folds]) if all(("", f"{q}/{f}") in told for f in folds) else -1.0 for q in range(len(taus))]
        pair = fit(rows, self._pair("all", taus[int(np.argmax(means))])) if max(means) >= 0 else []
        if not pair or not all(f.usable and f.n >= LEAST for f in pair):
            raise ValueError("every threshold leaves a side with too few rows or a single class")
        return LinearDetectorModel._of(self, pair, pair[1].problem.side[0])


class LinearDetectorModel(Model, _Detector, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``predictionCol``, the decision value, by column expressions. Its params hold all it has learned: per expert and term its place, a second place that multiplies it (or -1), offset, scale and weight."""

    weights = Param(Params._dummy(), "weights", "per expert: place, factor, factor's mean and deviation, mean, scale and weight of each term, and the intercept", TypeConverters.toListFloat)
    terms = Param(Params._dummy(), "terms", "how many terms each expert has", TypeConverters.toListInt)
    middle = Param(Params._dummy(), "middle", "what stands in for missing features", TypeConverters.toListFloat)
    threshold = Param(Params._dummy(), "threshold", "where the second expert begins; none for a single one", TypeConverters.toListFloat)

    def __init__(self) -> None:
        super().__init__()
        self._defaults()

    @classmethod
    def _of(cls, made: _Detector, fits: list[Fitted], tau: float | None) -> LinearDetectorModel:
        flat, terms = [], []
        for f in fits:
            p = f.problem
            n = len(f.mean) - len(p.gated)
            places = [*(range(n) if p.columns is None else p.columns), *p.gated]
            mean, sd = f.gate or (0.0, 1.0)
            for i, (place, m, s, w) in enumerate(zip(places, f.mean, f.scale, f.w[:-1], strict=True)):
                flat += [place, p.gate if i >= n else -1, mean, sd, m, s, w]
            flat.append(f.w[-1])
            terms.append(len(places))
        model = made._copyValues(cls())
        middle = [] if fits[0].middle is None else fits[0].middle.tolist()
        return model._set(weights=[float(v) for v in flat], terms=terms, middle=middle, threshold=[] if tau is None else [float(tau)])

    def _transform(self, df: DataFrame) -> DataFrame:
        x, flat = F.col(self._get("featuresCol")).cast("array<double>"), self._get("weights")
        middle = F.array(*map(F.lit, self._get("middle")))
        if self._get("middle"):
            x = F.zip_with(x, middle, lambda v, m: F.coalesce(F.nanvl(v, F.lit(None).cast("double")), m))
        out, at = [], 0
        for n in self._get("terms"):
            rows = [flat[at + 7 * i : at + 7 * i + 7] for i in range(n)]
            kept = F.array(*[F.struct(F.lit(int(r[0])).alias("at"), F.lit(int(r[1])).alias("by"), *[F.lit(v).alias(k) for k, v in zip(("gm", "gs", "m", "s", "w"), r[2:], strict=True)]) for r in rows])
            one = lambda t: (F.get(x, t["at"]) * F.when(t["by"] < 0, 1.0).otherwise((F.get(x, F.greatest(t["by"], F.lit(0))) - t["gm"]) / t["gs"]) - t["m"]) / t["s"] * t["w"]
            out.append(F.aggregate(F.transform(kept, one), F.lit(flat[at + 7 * n]), lambda a, v: a + v))
            at += 7 * n + 1
        score = out[0]
        if self._get("threshold"):
            gate, tau = F.get(F.col(self._get("featuresCol")).cast("array<double>"), F.lit(self._get("gate"))), self._get("threshold")[0]
            score = F.when(gate < tau, out[0]).when((gate >= tau) & ~F.isnan(gate), out[1])
        return df.withColumn(self._get("predictionCol"), score)
