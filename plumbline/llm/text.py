"""Word splitting and small shared helpers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from plumbline.operators.lineage import shared_dir

#: White space of every contract: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def word_array(text: Column) -> Column:
    """Words of a text in order; null and blank texts give an empty array."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_RUN))


LETTERS = regex.compile(r"\p{L}+")
_NO_SIGNS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def letter_words(text: str | None) -> Counter:
    """Counts of a text's runs of letters (category L), in lower case."""
    words = Counter((text or "").lower().encode().translate(_NO_SIGNS).decode().split())
    for w in [w for w in words if not w.isalpha()]:  # signs and numbers beyond ASCII
        n = words.pop(w)
        for part in LETTERS.findall(w):
            words[part] += n
    return words


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it (lambdas repeat what they name)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves the remainder; a null id is held out, so it is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) == remainder, F.lit(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scratch: list[list[DataFrame]] = []


def materialise(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    for held in _scratch[-1:]:
        held.append(back)
    return back


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What ``materialise`` writes inside goes at the end, but for rows that the yielded function has written; those are kept."""
    _scratch.append([])

    def kept(df: DataFrame) -> DataFrame:
        back = materialise(df)
        _scratch[-1][:] = [x for x in _scratch[-1] if x is not back]
        return back

    try:
        yield kept
    finally:
        for df in _scratch.pop():
            discard(df)


def smallest_hashes(ids: DataFrame, sample: int) -> DataFrame:
    """The ``sample`` rows (doc_id, ...), one per id, of the smallest id hashes. Rows far beyond them are left out before any are ordered, so that few more than ``sample`` meet in one task."""
    n, top = ids.count(), 1 << 40
    some = ids.withColumn("_hash", F.pmod(F.xxhash64("doc_id"), F.lit(top)))
    if n > sample:
        some = some.where(F.col("_hash") < int(top * min(1.0, (1.2 * sample + 200) / n)))
    return some.orderBy("_hash", "doc_id").limit(sample).drop("_hash")


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def one_thread(spark: SparkSession) -> None:
    """Matrix products of Python workers started from now on run in one thread, as a task has one core; a value that is already set stays."""
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")


def schema_with(fields: list[StructField], more: str) -> StructType:
    """The fields, whatever their names hold, and further ones written as DDL."""
    return StructType([*fields, *StructType.fromDDL(more).fields])
