"""Token windows, spans and contexts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

BLANKS = np.array([32, 9, 10, 11, 12, 13], np.uint32)


def tokens(text: Column) -> Column:
    """The default tokenizer: runs of non-blank characters. Others plug in as any array column."""
    return F.regexp_extract_all(text, F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))


def n_windows(n: Column, width: int, overlap: int) -> Column:
    if overlap >= width:
        raise ValueError("windows must advance: overlap < width")
    return F.when(n <= 0, 0).when(n <= width, 1).otherwise(1 + F.ceil((n - width) / F.lit(float(width - overlap)))).cast("long")


def windows(df: DataFrame, n: str, width: int = 1800, overlap: int = 256) -> DataFrame:
    """One row per window of a row's ``n`` tokens: win (from 0), start, end. A table function without state."""
    k = n_windows(F.col(n), width, overlap)
    each = df.withColumn("win", F.explode(F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1))))
    start = F.col("win") * (width - overlap)
    return each.withColumns({"start": start, "end": F.least(start + width, F.col(n))})


def _edges(text: str | None) -> np.ndarray:
    """1 where a token begins and -1 behind its end, in one pass over the text's code points."""
    word = ~np.isin(np.frombuffer((text or "").encode("utf-32-le"), np.uint32), BLANKS)
    return np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))


@pandas_udf(StructType([StructField(n, ArrayType(IntegerType())) for n in ("starts", "ends")]))
def offsets(text: pd.Series) -> pd.DataFrame:
    """Half-open places of the default tokenizer's tokens, in code points; NULL has none."""
    edges = [_edges(t) for t in text]
    return pd.DataFrame({"starts": [np.flatnonzero(e == 1).astype(np.int32) for e in edges], "ends": [np.flatnonzero(e == -1).astype(np.int32) for e in edges]})


@pandas_udf(ArrayType(IntegerType()))
def token_starts(text: pd.Series) -> pd.Series:
    """Where the default tokenizer's tokens begin."""
    return pd.Series([np.flatnonzero(_edges(t) == 1).astype(np.int32) for t in text])


@pandas_udf(ArrayType(BooleanType()))
def stops_at(text: pd.Series, places: pd.Series) -> pd.Series:
    """Per place whether a stop (one of ``.!?``) stands there, in one pass over the text's code points."""
    stops = np.array([ord(c) for c in ".!?"], np.uint32)
    return pd.Series([np.isin(np.frombuffer((t or "").encode("utf-32-le"), np.uint32)[np.asarray(p, int)], stops) for t, p in zip(text, places, strict=True)])


@pandas_udf(ArrayType(IntegerType()))
def places_in(text: pd.Series, keys: pd.Series) -> pd.Series:
    """Where each key stands in the text, from 0: behind the one found before it, else anywhere, -1 where nowhere."""
    out = []
    for t, some in zip(text, keys, strict=True):
        found, cursor = [], 0
        for k in some if some is not None else ():
            at = t.find(k, cursor)
            at = at if at >= 0 else t.find(k)
            cursor = at + len(k) if at >= 0 else cursor
            found.append(at)
        out.append(found)
    return pd.Series(out)


def kept_context(text: Column, ends: Column, width: int) -> Column:
    """The text up to the end of token ``width``; the whole text where there are fewer. ``ends``: end offsets of tokens."""
    return F.when(F.size(ends) >= width, F.substring(text, F.lit(1), F.get(ends, F.lit(width - 1)))).otherwise(text)


def first_tokens(text: Column, ends: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th token."""
    return F.substring(text, F.lit(1), F.get(ends, (n - 1).cast("int")))


def prefix_until(df: DataFrame, keys: list[str], order: list, size: str, budget: int) -> DataFrame:
    """Rows in order until their sizes reach ``budget``: the rows before which less than that was taken, with what is used of each."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = df.withColumn("before", before)
    return run.where(F.col("before") < budget).withColumn("used", F.least(F.col(size), budget - F.col("before")))
