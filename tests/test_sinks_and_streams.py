"""Resumable sinks, reports of any shape, configuration, and shards that arrive."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline import streaming
from plumbline.operators import joins
from plumbline.sources import tables
from plumbline.sources.config import Config


def test_a_killed_write_is_redone_and_a_finished_one_is_not(spark, tmp_path):
    out, schema = str(tmp_path / "out"), "k string, v long"
    df = spark.range(30).select(F.element_at(F.array(F.lit("a/b"), F.lit("c d"), F.lit(None).cast("string")), (F.col("id") % 3 + 1).cast("int")).alias("k"), F.col("id").alias("v"))
    bad = df.select("k", F.when(F.col("v") == 20, F.raise_error(F.lit("killed"))).otherwise(F.col("v")).cast("long").alias("v"))
    with pytest.raises(Exception, match="killed"):
        tables.write_once(bad, out, "k")
    assert tables.complete_parts(spark, out) == []
    # one part is there without its mark, as if its mover had died
    df.where("k = 'c d'").limit(1).write.parquet(f"{out}/_part=c d")
    assert sorted(tables.write_once(df.where("k is not null"), out, "k")) == ["a/b", "c d"]
    assert sorted(map(tuple, tables.read_once(spark, out, schema).collect())) == sorted(map(tuple, df.where("k is not null").collect()))
    assert tables.write_once(df, out, "k") == [tables.NONE]
    # all parts are complete: nothing is read, so nothing fails
    assert tables.write_once(bad, out, "k") == []
    assert sorted(map(str, tables.read_once(spark, out, schema).collect())) == sorted(map(str, df.collect()))


def test_one_part_and_none(spark, tmp_path):
    assert tables.write_once(spark.range(3), str(tmp_path / "a")) == ["all"] and tables.write_once(spark.range(9), str(tmp_path / "a")) == []
    assert tables.write_once(spark.range(0), str(tmp_path / "b")) == ["all"] and tables.write_once(spark.range(9), str(tmp_path / "b")) == []
    assert tables.read_once(spark, str(tmp_path / "a"), "id long").count() == 3 and tables.read_once(spark, str(tmp_path / "b"), "id long").count() == 0


def test_reports_of_any_shape(spark, tmp_path):
    for n, held in {"a": {"auc": {"x": 0.5, "y": {"lo": 1}}, "n": 3}, "b": {"auc": [1, 2], "n": "many"}, "c": 7}.items():
        (tmp_path / f"{n}.json").write_text(json.dumps(held, indent=1))
    (tmp_path / "d.json").write_text("no json {")
    reports = tables.read_any_report(spark, str(tmp_path)).withColumn("name", F.regexp_extract("path", r"(\w)\.json", 1))
    got = {r.name: (r.x, r.lo, r.n) for r in tables.fields(reports, "report", {"x": ("$.auc.x", "double"), "lo": ("$.auc.y.lo", "int"), "n": ("$.n", "int")}).collect()}
    assert got == {"a": (0.5, 1, 3), "b": (None, None, None), "c": (None, None, None), "d": (None, None, None)}
    each = tables.exploded(reports, "report", "$.auc").select("name", "pos", "key", F.to_json("value").alias("v")).collect()
    assert sorted((r.name, r.pos, r.key, r.v) for r in each) == [("a", 0, "x", "0.5"), ("a", 1, "y", '{"lo":1}'), ("b", 0, None, "1"), ("b", 1, None, "2")]


def test_strict_join_raises(spark):
    left, block = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert sorted(map(tuple, joins.covered_join(left, block, ["k"]).collect())) == [(1, "x"), (2, "y")]
    for wrong, text in ((block.where("k = 1"), "no row"), (block.unionByName(block.where("k = 2")), "several rows")):
        with pytest.raises(Exception, match=text):
            joins.covered_join(left, wrong, ["k"]).collect()


def test_config_of_both_kinds(tmp_path):
    yaml = pytest.importorskip("yaml")
    held = {"params": {"width": 512, "overlap": 128}, "models": ["m1", "m2"]}
    (tmp_path / "c.json").write_text(json.dumps(held))
    (tmp_path / "c.yaml").write_text("# comment\n" + yaml.safe_dump(held))
    want = Config(width=512, overlap=128, models=("m1", "m2"))
    assert Config.read(str(tmp_path / "c.json")) == Config.read(str(tmp_path / "c.yaml")) == want
    (tmp_path / "bad.yml").write_text("params:\n  widht: 3\n")
    with pytest.raises(ValueError, match="widht"):
        Config.read(str(tmp_path / "bad.yml"))


def test_latex(spark):
    text = tables.render_latex(spark.createDataFrame([("a_b & c", 0.5), (None, 1.0)], "name_ string, v double"))
    assert text.splitlines() == [r"\begin{tabular}{ll}", r"\toprule", r"name\_ & v \\", r"\midrule", r"a\_b \& c & 0.5 \\", r" & 1.0 \\", r"\bottomrule", r"\end{tabular}"]


def test_runs_are_told_once_complete_or_overdue(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema, t = "run string, shard long, n_shards long, n_rows long, ts timestamp", datetime(2024, 1, 1)
    steps = [
        [("a", 0, 2, 10, t), ("b", 0, 3, 5, t), ("a", 0, 2, 10, t)],  # a shard that comes twice
        [("a", 1, 2, 20, t + timedelta(minutes=5)), ("b", 2, 3, 6, t + timedelta(minutes=5))],
        [("c", 0, 1, 7, t + timedelta(minutes=10)), ("a", 1, 2, 20, t + timedelta(minutes=10))],
        [("d", 0, 2, 1, t + timedelta(hours=5))],  # the watermark passes what b may wait
        [("d", 1, 2, 1, t + timedelta(hours=5))],
    ]
    source, out = str(tmp_path / "in"), []
    os.makedirs(source)
    try:
        stream = spark.readStream.schema(schema).parquet(source)
        for i, rows in enumerate(steps):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            q = streaming.complete_runs(stream, 3600, "10 minutes").writeStream.foreachBatch(lambda df, _, i=i: out.extend((i, *r) for r in df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted(r[1:] for r in out) == [("a", "complete", 2, 2, 30), ("b", "incomplete", 2, 3, 11), ("c", "complete", 1, 1, 7), ("d", "complete", 2, 2, 2)]
    assert dict((r[1], r[0]) for r in out)["a"] == 1


def test_a_split_is_read_alone(spark, tmp_path):
    """Other folders are not scanned: one that can't be read does no harm."""
    root = str(tmp_path / "set")
    df = spark.range(40).select("id", F.concat(F.lit("set "), (F.col("id") % 2).cast("string")).alias("dataset"), F.element_at(F.array(F.lit("dev"), F.lit("test")), (F.col("id") % 4 / 2 + 1).cast("int")).alias("split"))
    tables.write_splits(df, root)
    (tmp_path / "set" / "dataset=set 1" / "split=dev" / "part-bad.parquet").write_text("no parquet")
    got = tables.read_split(spark, root, "id long", ["set 0"], ["dev"])
    assert sorted(r.id for r in got.collect()) == [r.id for r in df.where("dataset = 'set 0' and split = 'dev'").orderBy("id").collect()]
    assert tables.read_split(spark, root, "id long", splits=["test"]).count() == 20 and "PartitionFilters: [isnotnull" in got._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="no split named train"):
        tables.read_split(spark, root, "id long", splits=["train"])
