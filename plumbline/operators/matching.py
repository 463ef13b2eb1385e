"""Which texts hold which passages, without a test of all pairs."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from plumbline.operators.lineage import written
from plumbline.operators.tokens import tokens

#: Words of a key, and signs of a key of a passage that has no whole word inside.
WORDS, SIGNS = 3, 4
_BLANKS = re.compile("[ \t\n\x0b\f\r]+")


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` codes."""
    if len(codes) < n:
        return np.empty(0, np.int64)
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def word_keys(n: int, inner: bool):
    """Column function: hashes of a text's runs of ``n`` words, each once; ``inner`` leaves out its first and last word, which may be parts of words elsewhere."""

    @pandas_udf(ArrayType(LongType()))
    def run(text: pd.Series) -> pd.Series:
        out, crc = [], zlib.crc32
        for t in text:
            words = [w for w in _BLANKS.split(t or "") if w]
            words = words[1:-1] if inner else words
            out.append(np.unique(_grams(np.fromiter((crc(w.encode()) for w in words), np.uint64, len(words)), n)))
        return pd.Series(out)

    return run


def sign_keys(n: int):
    """Column function: hashes of a text's runs of ``n`` signs, each once."""

    @pandas_udf(ArrayType(LongType()))
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([np.unique(_grams(np.frombuffer((t or "").encode("utf-32-le"), np.uint32).astype(np.uint64), n)) for t in text])

    return run


def _met(docs: DataFrame, passages: DataFrame, of_text: Column, of_passage: Column) -> DataFrame:
    """(doc_id, item_id): texts that hold each passage's rarest key."""
    keys = passages.select("item_id", F.explode(of_passage).alias("h"))
    # what no passage asks for is gone before anything is dealt
    seen = written(docs.select("doc_id", F.explode(of_text).alias("h")).join(keys.select("h").distinct(), "h", "left_semi"))
    times = seen.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rarest = keys.join(times, "h", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h")).alias("k")).where("k.n > 0")
    return seen.join(rarest.select("item_id", F.col("k.h").alias("h")), "h").select("doc_id", "item_id")


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id, t, text, place) of rows (doc_id, t) and (item_id, text): where each passage first stands in each text, from 1.

    The words inside a passage, all but its first and last, stand whole wherever it does, so a text that holds the passage
    holds each run of three of them. Texts and passages meet by the passage's rarest run, as counted over the texts, so that a
    run that a third of all texts have is no key unless it is all a passage has; then those texts do have to be looked at.
    Shorter passages meet by the run of their inner words, and those without any by their rarest four signs. Only what
    meets is compared. An empty passage stands nowhere.
    """
    n = F.size(tokens(F.col("text"))) - 2
    sized = written(passages.where("text <> ''").select("item_id", "text", F.when(n >= WORDS, WORDS).when(n > 0, n).otherwise(-F.least(F.length("text"), F.lit(SIGNS))).alias("n")))
    met = None
    for k in sorted(r["n"] for r in sized.select("n").distinct().collect()):  # a few lengths of keys
        some = sized.where(F.col("n") == k)
        pairs = _met(docs, some, word_keys(k, False)("t"), word_keys(k, True)("text")) if k > 0 else _met(docs, some, sign_keys(-k)("t"), sign_keys(-k)("text"))
        met = pairs if met is None else met.unionByName(pairs)
    if met is None:
        met = docs.join(sized.select("item_id"), F.lit(False)).select("doc_id", "item_id")
    both = docs.join(met, "doc_id").join(sized.select("item_id", "text"), "item_id")
    return both.select("doc_id", "item_id", "t", "text", F.instr("t", F.col("text")).cast("long").alias("place")).where("place > 0")
