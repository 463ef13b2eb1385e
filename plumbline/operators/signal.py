"""Signal operators that need an FFT or matrix products: Arrow-batched numpy, all rows of one length at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

CUT, WIDTH = 0.45, 8


def _by_length(*columns: pd.Series):
    """(places, stacked arrays) of the rows without NULL, one group per combination of lengths."""
    sizes = pd.concat([x.map(lambda v: -1 if v is None else len(v)) for x in columns], axis=1)
    sizes.columns = range(len(columns))
    for _, at in sizes[(sizes >= 0).all(axis=1)].groupby(list(sizes.columns)).groups.items():
        places = sizes.index.get_indexer(at)
        yield places, [np.stack(x.iloc[places].to_numpy()) for x in columns]


@pandas_udf(DoubleType())
def high_pass(x: pd.Series) -> pd.Series:
    """L2 norm of the components with an absolute frequency of at least ``CUT``; NULL and empty arrays have none."""
    out = np.full(len(x), np.nan)
    for places, (rows,) in _by_length(x):
        n = rows.shape[1]
        if n:
            kept = np.fft.fft(rows, axis=1)[:, np.abs(np.fft.fftfreq(n)) >= CUT]
            out[places] = np.sqrt((np.abs(kept) ** 2).sum(1) / n)
    return pd.Series(out).where(~np.isnan(out), None).astype(object)


def causal_rows(width: int = WIDTH):
    """Attention rows of an answer's queries over all keys, causal mask and scaled softmax; both sides come flattened, as rows of ``width``."""

    @pandas_udf(ArrayType(DoubleType()))
    def run(q: pd.Series, k: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(q), dtype=object)
        for places, (a, b) in _by_length(q, k):
            a, b = a.reshape(len(a), -1, width), b.reshape(len(b), -1, width)
            z = a @ b.transpose(0, 2, 1) / np.sqrt(width)
            later = np.arange(b.shape[1])[None, :] > np.arange(b.shape[1] - a.shape[1], b.shape[1])[:, None]
            z = np.where(later, -np.inf, z)
            z = np.exp(z - z.max(2, keepdims=True))
            z /= z.sum(2, keepdims=True)
            for i, row in zip(places, z.reshape(len(z), -1), strict=True):
                out.iloc[i] = row
        return out

    return run
