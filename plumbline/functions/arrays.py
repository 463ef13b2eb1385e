"""Array algebra on columns: every function is one JVM-side expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = F.lit


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, total(x) / F.size(x))


def doubles(x: Column) -> Column:
    """Stored as float, computed as double."""
    return x.cast("array<double>")


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def cosine(x: Column, y: Column, floor: float = 1e-8) -> Column:
    """Cosine with the norms held above a floor."""
    return dot(x, y) / (F.greatest(F.sqrt(dot(x, x)), F.lit(floor)) * F.greatest(F.sqrt(dot(y, y)), F.lit(floor)))


def log_sum_exp(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.log(total(F.transform(x, lambda v: F.exp(v - top))))


def log_softmax(x: Column) -> Column:
    norm = log_sum_exp(x)
    return F.transform(x, lambda v: v - norm)


def jensen_shannon(lp: Column, lq: Column) -> Column:
    """Divergence of two log-probability vectors, in nats."""

    def middle(a: Column, b: Column) -> Column:
        return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))) - F.log(F.lit(2.0))

    half = lambda a, b: total(F.zip_with(a, b, lambda u, v: F.exp(u) * (u - middle(u, v))))
    return 0.5 * half(lp, lq) + 0.5 * half(lq, lp)


def top_positions(w: Column, share: float) -> Column:
    """0-based places of the ceil(share * n) largest weights (one at least), largest first, ties to the earlier place."""
    ranked = F.array_sort(F.transform(w, lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    return F.transform(F.slice(ranked, F.lit(1), F.greatest(F.lit(1), F.ceil(F.size(w) * F.lit(share)).cast("int"))), lambda s: s["i"])


def lookback(w: Column, context: int) -> Column:
    """Per answer token i: mean attention on the context over itself plus the mean on the answer so far."""
    ctx = mean(F.slice(w, 1, context))
    new = lambda i: total(F.slice(w, F.lit(context + 1), i + 1)) / (i + 1)
    return F.transform(F.sequence(F.lit(0), F.size(w) - context - 1), lambda i: ctx / (ctx + new(i)))


def lookback_of(w: Column, context: int, i: Column) -> Column:
    """The ratio of answer token ``i`` from its own row of weights: mean on the context over itself plus the mean on the answer tokens up to its own."""
    ctx = mean(F.slice(w, 1, context))
    return ctx / (ctx + total(F.slice(w, F.lit(context + 1), i.cast("int") + 1)) / (i + 1))


def max_abs_gap(x: Column, y: Column) -> Column:
    return F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def joined_max(x: Column, y: Column) -> Column:
    """Element-wise maximum over the common prefix, then the rest of ``x``."""
    n = F.least(F.size(x), F.size(y))
    return F.concat(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda a, b: F.greatest(a, b)), F.slice(x, n + 1, F.size(x)))
