"""Scalar expressions: missing values, labels, ids, ratios, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers as NULL, so that aggregates skip them."""
    return df.withColumns({f.name: F.nanvl(f.name, F.lit(None).cast(f.dataType)) for f in df.schema if isinstance(f.dataType, (FloatType, DoubleType))})


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def normal_label(x: Column) -> Column:
    """Trimmed, lower case, hyphens for blanks and underscores."""
    return F.translate(F.lower(F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", "")), "_ ", "--")


def collapse(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+", " ")


def text_id(x: Column, digits: int = 12) -> Column:
    return F.substring(F.md5(x), 1, digits)


def safe_share(part: Column, whole: Column, least: float = 1e-3) -> Column:
    """part / whole, NULL where the whole is too small to divide by."""
    return F.when(F.abs(whole) > least, part / whole)


def verdict(lo: Column, hi: Column) -> Column:
    """Three-way reading of an interval of differences."""
    return F.when(lo > 0, "ahead").when(hi < 0, "behind").otherwise("tie")


def prompt(context: Column, query: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), query, F.lit("\n\nAnswer: "))


def clean_paragraphs(x: Column) -> Column:
    """Non-blank lines; the whole text where there are none."""
    some = F.filter(F.split(x, "\n"), lambda p: F.trim(p) != "")
    return F.when(F.size(some) == 0, F.array(x)).otherwise(some)


def displaced(prefix: Column, context: Column) -> Column:
    """The context behind a prefix and a blank line; an empty prefix leaves it as it is."""
    return F.when(prefix == "", context).otherwise(F.concat(prefix, F.lit("\n\n"), context))
