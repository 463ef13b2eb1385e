"""Scans and sinks of cases, sentences, blocks, logs and reports, with schemas stated and never inferred."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalar import nan_to_null

CASES = "case_id string, source_id string, dataset string, task string, query string, context string, answer string, sent_spans array<array<int>>"
SENTENCES = "case_id string, sent_idx int, source_id string, label int, n_tok int, mean_surprisal double, gap double, chunk_drops string"
RUN_LOG = "tag string, model string, dataset string, minutes double, max_cases int, params map<string,string>, env map<string,string>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line; spans become structs."""
    rows = spark.read.schema(CASES).json(path)
    return rows.withColumn("sent_spans", F.transform("sent_spans", lambda s: F.struct(s[0].alias("start"), s[1].alias("end"))))


def read_sentences(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Header CSV, gzip by suffix; missing numbers are NULL. ``columns`` prunes the scan."""
    rows = nan_to_null(spark.read.schema(SENTENCES).csv(path, header=True, escape='"'))
    return rows.select(*columns) if columns else rows


def with_signals(sentences: DataFrame) -> DataFrame:
    """Derived columns: prior_logprob, and the worst and summed negative change of chunk_drops; an empty list gives NULL."""
    drops = F.filter(F.from_json("chunk_drops", "array<double>"), lambda v: v.isNotNull())
    some = F.size(drops) > 0
    summed = -F.aggregate(F.filter(drops, lambda v: v < 0), F.lit(0.0), lambda a, b: a + b)
    return sentences.withColumns({"prior_logprob": -F.col("mean_surprisal") - F.col("gap"), "min_drop": F.when(some, F.array_min(drops)), "sum_drop": F.when(some, summed)})


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Append-only log; trial runs with a case limit are skipped."""
    return spark.read.schema(RUN_LOG).json(path).where(F.coalesce("max_cases", F.lit(0)) == 0)


def read_runs(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Parquet blocks found by file name anywhere below ``root``."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).parquet(root)


def write_splits(df: DataFrame, root: str) -> None:
    """Rows with ``dataset`` and ``split`` as a data set of folders; the folders at hand are replaced, others stay."""
    write_block(df, root, "dataset", "split")


def read_split(spark: SparkSession, root: str, schema: str, datasets: list[str] | None = None, splits: list[str] | None = None) -> DataFrame:
    """The named data sets and splits of such folders, all where none are named. Only their folders are listed as files to scan; a name that isn't there is an error."""
    rows = spark.read.schema(f"{schema}, dataset string, split string").parquet(root)
    for column, wanted in (("dataset", datasets), ("split", splits)):
        if wanted is None:
            continue
        store, path_of = _folder(spark, root)
        at = f"{root}/*/split=*" if column == "split" else f"{root}/dataset=*"
        there = {unquote(f.getPath().getName().split("=", 1)[1]) for f in store.globStatus(path_of(at))}
        if lacking := sorted(set(wanted) - there):
            raise ValueError(f"no {column} named {', '.join(lacking)}")
        rows = rows.where(F.col(column).isin(wanted))
    return rows


def write_block(df: DataFrame, path: str, *by: str) -> None:
    """Feature block as Parquet, partitioned by run; only the partitions at hand are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


#: What a writer calls the part of null and empty values.
NONE = "__HIVE_DEFAULT_PARTITION__"


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and what makes paths of it."""
    sc = spark.sparkContext
    path_of = sc._jvm.org.apache.hadoop.fs.Path
    return path_of(path).getFileSystem(sc._jsc.hadoopConfiguration()), path_of


def complete_parts(spark: SparkSession, path: str) -> list[str]:
    """The parts of a resumable sink that are marked as complete."""
    store, path_of = _folder(spark, path)
    marks = path_of(f"{path}/_complete")
    return sorted(unquote(f.getPath().getName()) for f in store.listStatus(marks)) if store.exists(marks) else []


def write_once(df: DataFrame, path: str, by: str | None = None) -> list[str]:
    """Resumable sink: writes what is not complete, and returns the parts it has written.

    Each value of ``by`` (texts, one part without it) is a part. All parts that lack a mark are written in one job below a
    folder of its own, then moved in, each whole, and marked. A write that is killed leaves parts without a mark, which the
    next one replaces; parts with a mark are not even read, as the filter reaches the scan.
    """
    spark = df.sparkSession
    store, path_of = _folder(spark, path)
    done = complete_parts(spark, path)
    name, kept = by or "part", df
    if by is None:
        if done:
            return []
        kept = df.withColumn(name, F.lit("all"))
    elif done:
        kept = df.where(~F.coalesce(F.nullif(F.col(by).cast("string"), F.lit("")), F.lit(NONE)).isin(done))
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    kept.withColumn("_part", F.col(name).cast("string")).write.partitionBy("_part").parquet(staged)
    written = []
    for folder in sorted((f.getPath() for f in store.listStatus(path_of(staged)) if f.isDirectory()), key=lambda f: f.getName()):
        part = folder.getName().split("=", 1)[1]  # as the writer has quoted it
        target = path_of(f"{path}/{folder.getName()}")
        if store.exists(target):  # moved, but not marked
            store.delete(target, True)
        if not store.rename(folder, target):
            raise OSError(f"could not move {folder} in")
        store.mkdirs(path_of(f"{path}/_complete"))
        store.create(path_of(f"{path}/_complete/{part}")).close()
        written.append(unquote(part))
    if by is None and not written:  # an empty part is complete too
        store.mkdirs(path_of(f"{path}/_complete"))
        store.create(path_of(f"{path}/_complete/all")).close()
        kept.drop(name).write.mode("append").parquet(f"{path}/_part=all")
        written = ["all"]
    store.delete(path_of(staged), True)
    return written


def read_once(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The complete parts of a resumable sink, by a stated schema."""
    rows = spark.read.schema(f"{schema}, _part string").parquet(path)
    return rows.where(F.coalesce("_part", F.lit(NONE)).isin(complete_parts(spark, path))).drop("_part")


def write_scores(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested reports by a stated schema; fields are read by their path."""
    return spark.read.schema(schema).json(path)


def parsed(reports: DataFrame, column: str, name: str = "report") -> DataFrame:
    """JSON texts as a VARIANT column, whatever their shape; text that is no JSON is NULL."""
    return reports.withColumn(name, F.try_parse_json(F.col(column)))


def read_any_report(spark: SparkSession, path: str) -> DataFrame:
    """(path, report): nested reports of unknown or differing shapes, a file each, as VARIANT; fields are read by their path where they are wanted."""
    files = spark.read.text(path, wholetext=True)
    return parsed(files.select(F.col("_metadata.file_path").alias("path"), "value"), "value").drop("value")


def fields(reports: DataFrame, column: str, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """``wanted`` names to (path, SQL type): a field that a report lacks, or that has another type, is NULL."""
    return reports.select("*", *[F.try_variant_get(F.col(column), path, kind).alias(name) for name, (path, kind) in wanted.items()])


def exploded(reports: DataFrame, column: str, path: str = "$") -> DataFrame:
    """A row per member of the object, or element of the array, at ``path``: ``pos``, ``key`` and ``value`` (VARIANT) beside the report's columns. Reports without one have no row."""
    at = F.try_variant_get(F.col(column).outer(), path, "variant")
    return reports.lateralJoin(reports.sparkSession.tvf.variant_explode(at))


def tagged(files: DataFrame, path: str, model: str | None = None, dataset: str | None = None, suffix: str = "_K5") -> DataFrame:
    """Files of run folders named model_dataset with a suffix, by either part."""
    name = F.element_at(F.split(path, "/"), -1)
    parts = F.split(F.substring_index(name, suffix, 1), "_")
    kept = files.where(F.endswith(name, F.lit(suffix)))
    for at, wanted in ((0, model), (1, dataset)):
        kept = kept if wanted is None else kept.where(F.get(parts, F.lit(at)) == wanted)
    return kept


def union_runs(frames: list[DataFrame]) -> DataFrame:
    """Ragged runs, one below the other; a detector that a run lacks is NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def render_markdown(df: DataFrame, limit: int = 200) -> str:
    """A small result as a table in text; the driver holds ``limit`` rows at most."""
    rows = df.limit(limit).collect()
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(["" if v is None else v for v in r]) for r in rows]])


LATEX = {c: f"\\{c}" for c in "&%$#_{}"} | {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def render_latex(df: DataFrame, limit: int = 200) -> str:
    """A small result as the rows of a table, special signs escaped; the driver holds ``limit`` rows at most."""
    rows = df.limit(limit).collect()
    line = lambda cells: " & ".join("".join(LATEX.get(c, c) for c in str(x)) for x in cells) + r" \\"
    body = [line(["" if v is None else v for v in r]) for r in rows]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"\toprule", line(df.columns), r"\midrule", *body, r"\bottomrule", r"\end{tabular}"])
