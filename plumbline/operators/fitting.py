"""Many balanced logistic regressions at once, each by Newton steps over Arrow batches.

A problem is a fit: a run, the folds it leaves out, a strength, which features it reads, an optional gate and an optional
side of the gate. A pass over the rows adds up the loss, gradient and Hessian of every open problem in each task; per
problem these are summed and solved where they meet, and only coefficients come to the driver and go out again with the
next pass. So no task holds a run, the number of passes is that of one fit, and what is on the driver and in a task
grows with problems times features (squared in a task), not with rows.

Features are imputed by medians of the rows a problem trains on, exact and only for features that miss values, then
standardised by its own means and deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.quantiles import order_statistics

PASSES, NEAR = 60, 1e-9


@dataclass(frozen=True)
class Problem:
    """``held``: folds left out; ``columns``: places in x, all where None; ``gate``: its place in x; ``gated``: places that also enter times the standardised gate; ``side``: rows with low <= gate < high, a row without a gate is on neither side."""

    run: str
    name: str
    c: float = 1.0
    held: tuple[int, ...] = ()
    columns: tuple[int, ...] | None = None
    gate: int | None = None
    gated: tuple[int, ...] = ()
    side: tuple[float, float] = (-np.inf, np.inf)

    def rows(self, x: np.ndarray, fold: np.ndarray) -> np.ndarray:
        return ~np.isin(fold, self.held) & self.on_side(x)

    def on_side(self, x: np.ndarray) -> np.ndarray:
        low, high = self.side
        return np.ones(len(x), bool) if low == -np.inf and high == np.inf else (x[:, self.gate] >= low) & (x[:, self.gate] < high)


@dataclass
class Fitted:
    """What a problem has learned: medians of its features, mean and deviation of its gate, of its columns, and coefficients with the intercept last."""

    problem: Problem
    middle: np.ndarray | None = None
    gate: tuple[float, float] | None = None
    n: int = 0
    positives: int = 0
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w: np.ndarray | None = None
    step: np.ndarray | None = field(default=None, repr=False)
    loss: float = np.inf
    size: float = 1.0
    open: bool = True

    def design(self, x: np.ndarray) -> np.ndarray:
        p = self.problem
        if self.middle is not None:
            x = np.where(np.isnan(x), self.middle, x)  # a missing gate too, where it is a factor
        z = x if p.columns is None else x[:, p.columns]
        if p.gated:
            z = np.hstack([z, x[:, p.gated] * ((x[:, [p.gate]] - self.gate[0]) / self.gate[1])])
        return z

    def standard(self, x: np.ndarray) -> np.ndarray:
        z = (self.design(x) - self.mean) / self.scale
        return np.hstack([z, np.ones((len(z), 1))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.w

    @property
    def usable(self) -> bool:
        return 0 < self.positives < self.n


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(run, rows, x, y, fold) of each run in a batch."""
    run = np.array(batch.column("run").to_pylist(), object)
    x = batch.column("x")
    width = len(x) and x.value_lengths()[0].as_py()
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), width) if len(x) else np.zeros((0, 0))
    y, fold = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("label", "fold"))
    for r in pd.unique(run):
        at = np.flatnonzero(run == r)
        yield r, at, flat[at], y[at], fold[at]


def _summed(rows: DataFrame, problems: list[Fitted], told: Callable[[Fitted, np.ndarray, np.ndarray], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray], solve: Callable[[Fitted, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Per problem: arrays that ``told`` gives for batches (state, x, y) are merged in tasks, then per problem, and solved there."""
    by_run: dict[str, list[int]] = {}
    for i, f in enumerate(problems):
        by_run.setdefault(f.problem.run, []).append(i)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for run, _, x, y, fold in _blocks(batch):
                for i in by_run.get(run, ()):
                    m = problems[i].problem.rows(x, fold)
                    if m.any():
                        own = told(problems[i], x[m], y[m])
                        sums[i] = own if i not in sums else merge(sums[i], own)
        for i, s in sums.items():
            yield pa.record_batch([pa.array([i], pa.int64()), pa.array([s.tobytes()], pa.binary())], names=["i", "s"])

    def whole(table: pa.Table) -> pa.Table:
        i = table.column("i")[0].as_py()
        total = None
        for s in sorted(table.column("s").to_pylist()):  # an order of its own, so that reruns agree to the last bit
            own = np.frombuffer(s)
            total = own if total is None else merge(total, own)
        return pa.table({"i": pa.array([i], pa.int64()), "s": pa.array([solve(problems[i], total).tobytes()], pa.binary())})

    parts = rows.select("run", "x", "label", "fold").mapInArrow(part, "i long, s binary")
    # one row of coefficients per problem
    return {r["i"]: np.frombuffer(r["s"]) for r in parts.groupBy("i").applyInArrow(whole, "i long, s binary").collect()}


def _moments(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(values)], values.mean(0), ((values - values.mean(0)) ** 2).sum(0)])


def _merged_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count, means and summed squared deviations of two sets together, without cancellation."""
    d = (len(a) - 1) // 2
    n = a[0] + b[0]
    gap = b[1 : d + 1] - a[1 : d + 1]
    return np.concatenate([[n], a[1 : d + 1] + gap * b[0] / n, a[d + 1 :] + b[d + 1 :] + gap**2 * a[0] * b[0] / n])


def _labelled_moments(values: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([[y.sum()], _moments(values)])


def _middles(rows: DataFrame, states: list[Fitted]) -> None:
    """Medians of the features that miss values, per run and set of held folds."""
    each = rows.select("run", "fold", F.posexplode("x").alias("j", "v"))
    missing = [(r["run"], r["j"]) for r in each.where(F.col("v").isNull() | F.isnan("v")).select("run", "j").distinct().collect()]  # features, not rows
    if not missing:
        return
    width = rows.select(F.max(F.size("x"))).first()[0]
    some = each.join(rows.sparkSession.createDataFrame(missing, "run string, j int"), ["run", "j"])
    found: dict[tuple, np.ndarray] = {}
    for held in {s.problem.held for s in states}:
        rest = some.where(~F.col("fold").isin(*held)) if held else some
        for r in order_statistics(rest, ["run", "j"], "v", [0.5]).collect():
            found.setdefault((r["run"], held), np.zeros(width))[r["j"]] = r["quantiles"][0]
    for s in states:
        s.middle = found.get((s.problem.run, s.problem.held), np.zeros(width))


def fit(rows: DataFrame, problems: list[Problem]) -> list[Fitted]:
    """Fits of rows (run, fold, x, label), which are read once a pass and so better written than derived. A problem whose rows are of one class, or whose gate is constant, has no coefficients."""
    states = [Fitted(p) for p in problems]
    _middles(rows, states)
    gated = [s for s in states if s.problem.gated]
    for i, s in _summed(rows, gated, lambda f, x, y: _moments(x[:, [f.problem.gate]]), _merged_moments, lambda f, t: t).items():
        gated[i].gate = s[1], float(np.sqrt(s[2] / max(s[0] - 1, 1)))
    states_ = [s for s in states if not s.problem.gated or (s.gate is not None and s.gate[1] > 1e-6)]
    merge = lambda a, b: np.concatenate([[a[0] + b[0]], _merged_moments(a[1:], b[1:])])
    for i, s in _summed(rows, states_, lambda f, x, y: _labelled_moments(f.design(x), y), merge, lambda f, t: t).items():
        f, d = states_[i], (len(s) - 2) // 2
        f.positives, f.n, f.mean = int(s[0]), int(s[1]), s[2 : d + 2]
        scale = np.sqrt(s[d + 2 :] / f.n)
        f.scale = np.where(scale > 0, scale, 1.0)
        f.w = f.step = None
    left = [f for f in states_ if f.usable]
    for f in left:
        f.w = f.step = np.zeros(len(f.mean) + 1)

    def told(f: Fitted, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Loss, gradient and Hessian at the point that is tried, without the ridge."""
        z = f.standard(x)
        weight = np.where(y == 1, f.n / (2 * f.positives), f.n / (2 * (f.n - f.positives)))
        s = z @ (f.w - f.size * f.step)
        p = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
        loss = (weight * np.logaddexp(0, -(2 * y - 1) * s)).sum()
        return np.concatenate([[loss], z.T @ (weight * (p - y)), ((z.T * (weight * p * (1 - p))) @ z).ravel()])

    def solved(f: Fitted, total: np.ndarray) -> np.ndarray:
        """Loss with the ridge, and the Newton step from the point that was tried."""
        w = f.w - f.size * f.step
        d = len(w)
        ridge = np.append(np.ones(d - 1), 0.0) / f.problem.c
        step = np.linalg.solve(total[d + 1 :].reshape(d, d) + np.diag(ridge + NEAR), total[1 : d + 1] + ridge * w)
        return np.concatenate([[total[0] + 0.5 * (ridge * w * w).sum()], step])

    for _ in range(PASSES):
        if not left:
            break
        for i, s in _summed(rows, left, told, np.add, solved).items():
            f = left[i]
            if s[0] > f.loss * (1 + 1e-12) and f.size > NEAR:  # too far: the half of the step
                f.size /= 2
                continue
            f.w, f.loss, f.step, f.size = f.w - f.size * f.step, s[0], s[1:], 1.0
            if np.abs(f.step).max() < NEAR:
                f.open = False
        left = [f for f in left if f.open]
    return states


def scored(rows: DataFrame, fits: list[Fitted], keep: tuple[str, ...] = (), held: bool = False) -> DataFrame:
    """(keep, run, name, score): rows by every usable fit of their run, on its side of the gate; with ``held`` only rows of the fold that the fit left out last."""
    by_run: dict[str, list[Fitted]] = {}
    for f in fits:
        if f.usable and f.w is not None:
            by_run.setdefault(f.problem.run, []).append(f)
    own = [f.name for f in rows.select(*keep).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, at, x, _, fold in _blocks(batch):
                for f in by_run.get(r, ()):
                    m = f.problem.on_side(x)
                    if held:
                        m &= fold == f.problem.held[-1]
                    if m.any():
                        score = f.scores(x[m])
                        some = batch.take(pa.array(at[m]))
                        yield pa.record_batch([*[some.column(f"_keep_{c}") for c in own], pa.array([r] * len(score)), pa.array([f.problem.name] * len(score)), pa.array(score)], names=[*own, "run", "name", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields]
    kept = rows.select("run", "x", "label", "fold", *[F.col(c).alias(f"_keep_{c}") for c in keep])
    return kept.mapInArrow(run, ", ".join([*fields, "run string", "name string", "score double"]))
