"""Points and spans of the same text or key: which points a span holds, which spans meet, and what is summed or best inside.

Two forms. Where both lie on one row as sorted arrays, a span's points are a range of them, found by binary search, so a
text of a million tokens is one pass and nothing is exploded or joined. Where they are rows of two tables, both are
dealt to bins of a fixed width, and only what shares a bin is compared: a long span is in several bins, a pair is taken in
the first bin that both have.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

#: A sentence: signs up to its stops; stops and line feeds that begin nothing are between sentences.
SENTENCE = r"[^.!?\n]+[.!?]*"

_PLACES = StructType([StructField(n, ArrayType(IntegerType())) for n in ("starts", "ends")])
_RANGES = StructType([StructField(n, ArrayType(IntegerType())) for n in ("lo", "hi")])


@pandas_udf(_PLACES)
def sentence_places(text: pd.Series) -> pd.DataFrame:
    """Half-open places of a text's sentences, in code points; NULL has none."""
    match, starts, ends = re.compile(SENTENCE), [], []
    for t in text:
        found = np.array([m.span() for m in match.finditer(t or "")], np.int32).reshape(-1, 2)
        starts.append(found[:, 0])
        ends.append(found[:, 1])
    return pd.DataFrame({"starts": starts, "ends": ends})


def _arrays(*columns: pd.Series) -> zip:
    none = np.empty(0, np.int64)
    return zip(*[[none if v is None else v for v in c] for c in columns], strict=True)


@pandas_udf(_RANGES)
def held_points(points: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """Per span the range [lo, hi) of the sorted points with start <= point < end. Spans may be in any order and overlap."""
    found = [(np.searchsorted(p, s), np.searchsorted(p, e)) for p, s, e in _arrays(points, starts, ends)]
    return pd.DataFrame({"lo": [a for a, _ in found], "hi": [np.maximum(a, b) for a, b in found]})


@pandas_udf(_RANGES)
def met_spans(a_starts: pd.Series, a_ends: pd.Series, b_starts: pd.Series, b_ends: pd.Series) -> pd.DataFrame:
    """Per span of ``a`` the range [lo, hi) of the spans of ``b`` that overlap it, both half-open. Those of ``b`` are sorted and apart, those of ``a`` need not be."""
    lo, hi = [], []
    for s, e, bs, be in _arrays(a_starts, a_ends, b_starts, b_ends):
        if len(bs) > 1 and (np.diff(bs) < 0).any() | (np.asarray(be)[:-1] > np.asarray(bs)[1:]).any():
            raise ValueError("spans to be met must be sorted and apart")
        lo.append(np.searchsorted(be, s, "right"))
        hi.append(np.maximum(lo[-1], np.searchsorted(bs, e)))
    return pd.DataFrame({"lo": lo, "hi": hi})


@pandas_udf(ArrayType(DoubleType()))
def best_in(values: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
    """Per range the largest value, NULL in an empty one."""
    out = []
    for v, a, b in _arrays(values, lo, hi):
        v, a, b = np.append(np.asarray(v, float), -np.inf), np.asarray(a, int), np.asarray(b, int)
        top = np.full(len(a), -np.inf)
        some = b > a
        if some.any():
            # maxima over [a, b) and [b, next a) in turn; every other one is asked for
            top[some] = np.maximum.reduceat(v, np.column_stack([a[some], b[some]]).ravel())[::2]
        out.append([None if np.isneginf(t) else t for t in top])
    return pd.Series(out)


@pandas_udf(ArrayType(BooleanType()))
def any_in(flags: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
    """Per range whether any flag is true in it."""
    out = []
    for v, a, b in _arrays(flags, lo, hi):
        run = np.concatenate([[0], np.cumsum(np.asarray(v, bool))])
        out.append(run[np.asarray(b, int)] > run[np.asarray(a, int)])
    return pd.Series(out)


@pandas_udf(ArrayType(IntegerType()))
def times_held(points: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
    """Per point in how many of the ranges it is."""
    out = []
    for p, a, b in _arrays(points, lo, hi):
        edge = np.zeros(len(p) + 1, np.int32)
        np.add.at(edge, np.asarray(a, int), 1)
        np.add.at(edge, np.asarray(b, int), -1)
        out.append(np.cumsum(edge[:-1], dtype=np.int32))
    return pd.Series(out)


def _binned(df: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    """Rows in every bin of ``width`` that [start, end) touches; an empty span touches none."""
    bins = F.when(end > start, F.sequence(F.floor(start / width), F.floor((end - 1) / width)))
    return df.withColumn("_bin", F.explode(bins))


def points_in_spans(points: DataFrame, spans: DataFrame, key: str, point: str, start: str, end: str, width: int = 1024) -> DataFrame:
    """Rows of ``points`` with each half-open span of the same key that holds them."""
    dealt = points.withColumn("_bin", F.floor(F.col(point) / width))
    met = dealt.join(_binned(spans, F.col(start), F.col(end), width), [key, "_bin"])
    return met.where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_bin")


def overlapping(a: DataFrame, b: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """Pairs of half-open spans (a_start, a_end) and (b_start, b_end) of one key that overlap, each pair once."""
    met = _binned(a, F.col("a_start"), F.col("a_end"), width).join(_binned(b, F.col("b_start"), F.col("b_end"), width), [key, "_bin"])
    first = F.floor(F.greatest("a_start", "b_start") / width)
    return met.where((F.col("b_end") > F.col("a_start")) & (F.col("b_start") < F.col("a_end")) & (F.col("_bin") == first)).drop("_bin")
