"""Columnar archives (.npz) and zip members, read in parallel from binary files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)


def read_npz(spark: SparkSession, path: str, scalars: dict[str, str], arrays: dict[str, str] | None = None) -> DataFrame:
    """Rows of named arrays: ``scalars`` name to SQL type, ``arrays`` name to element type; arrays come flattened per row. Only the named members are read."""
    names = [*scalars, *(arrays or {})]
    fields = ", ".join(["path string", "row_ord bigint", *[f"`{k}` {v}" for k, v in scalars.items()], *[f"`{k}` array<{v}>" for k, v in (arrays or {}).items()]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content)) as z:
                    held = {k: z[k] for k in names}
                n = len(next(iter(held.values())))
                for a in range(0, n, 4096):
                    part = {k: v[a : a + 4096] for k, v in held.items()}
                    flat = {k: list(v.reshape(len(v), -1).astype(np.float64)) if k in (arrays or {}) else v for k, v in part.items()}
                    yield pd.DataFrame({"path": p, "row_ord": np.arange(a, min(n, a + 4096)), **flat})

    return _files(spark, path, "*.npz").select("path", "content").mapInPandas(run, fields)


def read_zip_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(archive, member, content, digest) of the members whose whole name matches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = re.compile(pattern).fullmatch
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if match(name):
                            yield pd.DataFrame({"archive": [p], "member": [name], "content": [z.read(name)]})

    members = _files(spark, path, "*.zip").select("path", "content").mapInPandas(run, "archive string, member string, content binary")
    return members.withColumn("digest", F.sha2("content", 256))


def digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, digest) of files."""
    return _files(spark, path, glob).select("path", "length", F.sha2("content", 256).alias("digest"))


def pinned(found: DataFrame, digests_: dict[str, str]) -> DataFrame:
    """The files (path, digest), an error where one differs from the digest stated for its name."""
    name = F.element_at(F.split("path", "/"), -1)
    stated = F.element_at(F.create_map(*[F.lit(x) for pair in digests_.items() for x in pair]), name)
    fault = F.when(stated != F.col("digest"), F.raise_error(F.concat(F.lit("digest of "), name, F.lit(" differs"))))
    return found.where(fault.isNull())


def add_members(members: DataFrame, path: str) -> int:
    """Append members (member, content, digest) that the target lacks and return how many; one that is there with other bytes is an error, and nothing is ever overwritten."""
    spark = members.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        there = spark.read.parquet(path).select("member", F.col("digest").alias("there"))
        differs = members.join(there, "member").where("digest <> there").select("member").orderBy("member").limit(5).collect()
        if differs:
            raise ValueError(f"members with other bytes: {', '.join(r['member'] for r in differs)}")
        members = members.join(there, "member", "left_anti")
    n = members.count()
    if n:
        members.write.mode("append").parquet(path)
    return n
