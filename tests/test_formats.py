"""Archives as data sources: split scans, pruned members, commits."""

import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.sources import formats


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    formats.register(spark)


@pytest.fixture
def archive(tmp_path):
    rng = np.random.default_rng(1)
    held = {"case_id": np.array([f"c{i}" for i in range(1000)]), "n": np.arange(1000, dtype=np.int32), "block": rng.standard_normal((1000, 2, 3)).astype(np.float16), "s": rng.standard_normal(1000)}
    os.makedirs(tmp_path / "in")
    np.savez_compressed(tmp_path / "in" / "a.npz", **held, bad=np.array([{}], object))
    np.savez(tmp_path / "in" / "b.npz", **{k: v[:10] for k, v in held.items()})
    return str(tmp_path / "in"), held


@pytest.mark.parametrize("per", [7, 300, 100_000])
def test_one_archive_is_read_by_several_tasks(spark, archive, per):
    path, held = archive
    df = spark.read.format("npz").option("rowsPerPartition", per).schema("path string, row_ord long, block array<double>, case_id string, n int").load(path)
    rows = df.withColumn("task", F.spark_partition_id()).orderBy("path", "row_ord").collect()
    assert df.rdd.getNumPartitions() == -(-1000 // per) - (-10 // per) and len(rows) == 1010
    assert [r.n for r in rows] == [*range(1000), *range(10)] and [r.row_ord for r in rows] == [*range(1000), *range(10)]
    assert [r.case_id for r in rows[:1000]] == held["case_id"].tolist() and np.array_equal(np.array([r.block for r in rows[:1000]]), held["block"].reshape(1000, 6).astype(float))


def test_only_named_members_are_read(spark, archive, monkeypatch):
    """A member that can't be read doesn't matter until it is named; nor does a member that an archive lacks."""
    path, held = archive
    assert spark.read.format("npz").schema("s double").load(path).agg(F.sum("s")).first()[0] == pytest.approx(held["s"].sum() + held["s"][:10].sum())
    with pytest.raises(Exception, match="objects are never read"):
        spark.read.format("npz").schema("bad string").load(path).collect()
    opened = []
    real = zipfile.ZipFile.open
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, name, *a, **k: opened.append(name) or real(self, name, *a, **k))
    from pyspark.sql.types import StructType

    reader = formats.NpzReader(StructType.fromDDL("n int"), {"path": path})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1010 and set(opened) == {"n.npy"}


def test_wrong_shapes_and_missing_schema(spark, archive):
    path, _ = archive
    with pytest.raises(Exception, match="values a row"):
        spark.read.format("npz").schema("block double").load(path).collect()
    with pytest.raises(Exception, match="state the schema"):
        spark.read.format("npz").load(path)


@pytest.mark.parametrize("compression", ["deflate", "none"])
def test_what_is_written_comes_back(spark, tmp_path, compression):
    df = spark.range(500).select("id", F.concat(F.lit("é"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") % 7 > 0, F.col("id") / 3).alias("v"), F.array(F.col("id") * 1.5, F.lit(2.0)).alias("x")).repartition(3)
    out = str(tmp_path / "out")
    for _ in range(2):
        df.write.format("npz").option("rowsPerArchive", 100).option("dtypes", "x=float32").option("compression", compression).mode("append").save(out)
    assert not [n for n in os.listdir(out) if n.startswith("_")] and len(os.listdir(out)) >= 10
    back = spark.read.format("npz").schema("id long, name string, v double, x array<float>").load(out)
    rows = sorted(back.collect(), key=lambda r: r.id)
    assert [r.id for r in rows[::2]] == list(range(500)) == [r.id for r in rows[1::2]]
    assert all(r.name == f"é{r.id}" and r.x == [r.id * 1.5, 2.0] and (np.isnan(r.v) if r.id % 7 == 0 else r.v == r.id / 3) for r in rows)


def test_a_failing_task_leaves_the_target(spark, tmp_path):
    out = str(tmp_path / "out")
    spark.range(5).write.format("npz").mode("append").save(out)
    before = sorted(os.listdir(out))
    bad = spark.range(100).select(F.when(F.col("id") == 77, F.lit(None)).otherwise(F.col("id")).alias("id")).repartition(4)
    with pytest.raises(Exception, match="misses values"):
        bad.write.format("npz").mode("append").save(out)
    assert sorted(os.listdir(out)) == before
    with pytest.raises(Exception, match="never overwritten"):
        spark.range(5).write.format("npz").mode("overwrite").save(out)
    assert sorted(os.listdir(out)) == before


def test_zip_members_are_dealt_by_bytes(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for i in range(20):
            z.writestr(f"r/{i}.txt", "x" * 100)
        z.writestr("other.csv", "no")
    df = spark.read.format("zip").option("pattern", r"r/\d+\.txt").option("bytesPerPartition", 500).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 4 and sorted(r.member for r in df.collect()) == sorted(f"r/{i}.txt" for i in range(20))
    assert df.where(F.sha2("content", 256) != F.col("digest")).count() == 0
