"""Operators on small frames: ties, edges, missing values, empty groups, identities."""

import re
import zipfile
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import arrays, scalar
from plumbline.operators import bins, intervals, joins, matching, metrics, ranks, sampling, tokens
from plumbline.sources import archives, tables
from tests.plain_learning import precision


def one(df):
    return [tuple(r) for r in df.collect()]


def plain_auc(y, s):
    pos, neg = [v for v, k in zip(s, y) if k], [v for v, k in zip(s, y) if not k]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_auc_ties_missing_and_single_class(spark):
    rows = [("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("a", 0, 0.1), ("a", 1, float("nan")), ("a", 0, None), ("b", 1, 0.3), ("b", 1, 0.4), ("c", 0, 1.0), ("c", 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    got = {r.g: r.auc for r in metrics.auc(df, ["g"], "s", "y").collect()}
    assert got == {"a": 0.875, "b": None, "c": 0.5}


@pytest.mark.parametrize("spread", [0, 1e9])
def test_auc_buckets_and_negation(spark, spread):
    """One outlier, which cuts by value would give a bucket of its own, changes nothing."""
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 200), np.round(rng.standard_normal(200), 1)
    s[7] += spread
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s, "t": -s}))
    a = metrics.auc(df, [], "s", "y").first().auc
    assert a == pytest.approx(plain_auc(y, s)) and metrics.auc(df, [], "t", "y").first().auc == pytest.approx(1 - a)
    order = np.argsort(-s, kind="stable")
    values = sorted(set(s[order]), reverse=True)
    tp = n = ap = 0
    for v in values:
        hit = y[s == v].sum()
        tp, n = tp + hit, n + (s == v).sum()
        ap += hit * tp / n
    assert metrics.average_precision(df, [], "s", "y").first().ap == pytest.approx(ap / y.sum()) == pytest.approx(precision(y, s))


def test_average_precision(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, s double")
    assert metrics.average_precision(df, [], "s", "y").first().ap == pytest.approx((1 + 2 / 3) / 2)


def test_windows_lengths(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 9, 10, 11, 10 + 7 + 1, 40)], "n long")
    got = {}
    for r in tokens.windows(df, "n", 10, 3).collect():
        got.setdefault(r.n, []).append((r.start, r.end))
    for n in (0, 1, 9, 10, 11, 18, 40):
        want, start = [], 0
        while n:
            want.append((start, min(start + 10, n)))
            if want[-1][1] >= n:
                break
            start = want[-1][1] - 3
        assert sorted(got.get(n, [])) == want
    with pytest.raises(ValueError):
        tokens.n_windows(F.col("n"), 5, 5)


def test_points_on_span_edges(spark):
    points = spark.createDataFrame([(1, p) for p in (0, 4, 5, 9)], "k int, p int")
    spans = spark.createDataFrame([(1, 0, 5)], "k int, a int, b int")
    assert sorted(r.p for r in intervals.points_in_spans(points, spans, "k", "p", "a", "b").collect()) == [0, 4]


@pytest.mark.parametrize("n", [4, 5, 7, 9, 10])
def test_tertiles_like_ranked_quantiles(spark, n):
    got = [r.tertile for r in bins.tertiles(spark.range(n).withColumn("g", F.lit(1)), ["g"], "id", ()).orderBy("id").collect()]
    places = np.arange(n)  # right-closed at the thirds of the ranks, in whole numbers
    assert got == (1 + (3 * places > n - 1) + (3 * places > 2 * (n - 1))).tolist()
    assert got == (pd.qcut(pd.Series(range(n)).rank(method="first"), 3, labels=False) + 1).tolist() or (n - 1) % 3 == 0  # there, its edges are rounded


def test_quantile_and_cut_edges(spark):
    x = [1, 1, 1, 2, 3, 5, 8, 8]
    got = [r.bin for r in bins.quantile_bins(spark.createDataFrame([(v,) for v in x], "x long"), [], "x", 4).orderBy("x").collect()]
    assert got == (pd.qcut(pd.Series(x), 4, labels=False, duplicates="drop") + 1).tolist()
    assert one(spark.createDataFrame([(0,), (1,), (10,), (11,), (99,)], "x int").select(bins.cut(F.col("x"), [0, 10, 50]))) == [(None,), (0,), (0,), (1,), (None,)]


def test_donor_fallback(spark):
    rows = [("a", "s1", "dev", 3), ("b", "s2", "dev", 1), ("c", "s2", "dev", 2), ("d", "s3", "test", 9), ("e", "s1", "dev", 9)]
    df = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "id long, source string, split string, k long")
    got = {r.id: (r.donor, r.fallback) for r in sampling.donors(df, "id", "source", "split", "k").collect()}
    assert got[0] == (2, True) and got[4] == (2, True) and got[2][0] in (0, 4) and not got[2][1]
    assert set(got) == {0, 2, 4}  # one window needs no donor, and 3 has no other source


def test_donors_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i * 3 + 1, f"s{min(int(rng.integers(0, 6)), 3)}", int(rng.integers(0, 2)), int(rng.integers(0, 7))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, source string, split long, k long")
    got = {r.id: (r.donor, r.donor_k, r.fallback) for r in sampling.donors(df, "id", "source", "split", "k").collect()}
    draw = lambda i: (i * 1_103_515_245 + 12_345) % 2_147_483_648 // 65_536
    want = {}
    for i, src, part, k in rows:
        others = [(-d[3], d[0]) for d in rows if k >= 2 and d[3] >= 2 and d[1] != src and d[2] == part]
        fit = sorted(x for x in others if -x[0] >= k)
        if fit:
            x = fit[draw(i) % len(fit)]
            want[i] = (x[1], -x[0], False)
        elif others:
            x = max((-a, b) for a, b in others)
            want[i] = (x[1], x[0], True)
    assert got == want and 0 < len(want) < len(rows)


def test_count_upto(spark):
    rng = np.random.default_rng(9)
    marks, asked = [("a", int(v)) for v in rng.integers(0, 50, 200)], [("a", int(v), i) for i, v in enumerate(rng.integers(0, 60, 40))] + [("b", 5, 99)]
    got = ranks.count_upto(spark.createDataFrame(marks, "g string, v long"), spark.createDataFrame(asked, "g string, v long, id int"), ["g"], "v", "n", width=8).collect()
    assert {r.id: r.n for r in got} == {i: sum(g == h and w <= v for h, w in marks) for g, v, i in asked}


def test_numbered_with_ties_and_outliers(spark):
    rows = [("a", v, i) for i, v in enumerate([3.0, 1e12, 3.0, -5.0, 3.0, 0.0, 2.0] * 30)]
    got = ranks.numbered(spark.createDataFrame(rows, "g string, v double, i int"), ["g"], "v", "n", ("i",)).collect()
    assert {r.i: r.n for r in got} == {i: n for n, (_, _, i) in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}


def test_passages_met_by_words(spark):
    docs = [(1, "xx one two three four five yy"), (2, "one two three four five"), (3, "a short one"), (4, None), (5, "bone two three four fives")]
    passages = [(1, "one two three four five"), (2, "short"), (3, "two three"), (4, "never there at all here")]
    got = matching.containing(spark.createDataFrame(docs, "doc_id int, t string"), spark.createDataFrame(passages, "item_id int, text string")).collect()
    assert {(r.doc_id, r.item_id, r.place) for r in got} == {(d, i, (t or "").index(p) + 1) for d, t in docs for i, p in passages if p in (t or "")}


def test_joins_that_raise(spark):
    left = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    block = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (9, 9, 7)], "a int, b int, v int")
    assert sorted(one(joins.covered_join(left, block, ["a", "b"]))) == [(1, 1, 5), (1, 2, 6)]
    for bad in (block.where("b = 1"), block.unionByName(block.where("b = 1"))):
        with pytest.raises(Exception, match="of the block for 1/"):
            joins.covered_join(left, bad, ["a", "b"]).collect()
    named = spark.createDataFrame([("x",), ("y",)], "t string")
    assert named.select(joins.closed(F.col("t"), ["x", "y"])).count() == 2
    with pytest.raises(Exception, match="unknown value: y"):
        named.select(joins.closed(F.col("t"), ["x"])).collect()


def test_token_places(spark):
    texts = [None, "", "  ", "a", " ab  c\nd ", "é🙂 x\u00a0y z"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", tokens.offsets("t").alias("o"))
    for r in df.collect():
        spans = list(zip(r.o.starts, r.o.ends, strict=True))
        assert [(r.t or "")[a:b] for a, b in spans] == re.findall(r"[^ \t\n\x0b\f\r]+", r.t or "")
    kept = df.where("i = 4").select(tokens.kept_context(F.col("t"), F.col("o.ends"), 2), tokens.kept_context(F.col("t"), F.col("o.ends"), 9), tokens.first_tokens(F.col("t"), F.col("o.ends"), F.lit(1)))
    assert one(kept) == [(" ab  c", " ab  c\nd ", " ab")]


def test_signal_lengths_and_nulls(spark):
    from plumbline.operators.signal import causal_rows, high_pass

    rows = [(0, [1.0, -1.0, 1.0, -1.0]), (1, None), (2, []), (3, [1.0, 2.0, 3.0]), (4, [1.0, -1.0, 1.0, -1.0])]
    got = {r.i: r.h for r in spark.createDataFrame(rows, "i int, x array<double>").select("i", high_pass("x").alias("h")).collect()}
    assert got[0] == got[4] == pytest.approx(2.0) and got[1] is None and got[2] is None and got[3] == pytest.approx(0.0)
    q = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0, 0.0, 1.0]), (None, [1.0, 0.0])], "q array<double>, k array<double>").select(causal_rows(2)("q", "k").alias("w")).collect()
    e = np.exp(1 / np.sqrt(2))
    assert q[0].w == pytest.approx([e / (e + 1), 1 / (e + 1)]) and q[1].w is None


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 5.0, 5.0, -2.0], [0.0, 9.0])], "x array<double>, y array<double>")
    row = df.select(arrays.top_positions(F.col("x"), 0.5).alias("top"), arrays.joined_max(F.col("x"), F.col("y")).alias("j"), arrays.cosine(F.col("x"), F.col("x")).alias("c"), arrays.lookback(F.array(*map(F.lit, (1.0, 1.0, 3.0, 1.0))), 2).alias("r")).first()
    assert row.top == [1, 2] and row.j == [1.0, 9.0, 5.0, -2.0] and row.c == pytest.approx(1) and row.r == pytest.approx([0.25, 1 / 3])
    same = df.select(arrays.jensen_shannon(arrays.log_softmax(F.col("x")), arrays.log_softmax(F.col("x")))).first()[0]
    assert same == pytest.approx(0, abs=1e-12)


def test_scalar_rules(spark):
    df = spark.createDataFrame([("  Not_Supported \n",)], "t string")
    assert one(df.select(scalar.normal_label(F.col("t")))) == [("not-supported",)]
    assert one(spark.range(1).select(scalar.safe_share(F.lit(1.0), F.lit(0.0)), scalar.verdict(F.lit(-1.0), F.lit(1.0)))) == [(None, "tie")]
    assert one(spark.createDataFrame([("a\n \nb",), ("  ",)], "t string").select(scalar.clean_paragraphs(F.col("t")))) == [(["a", "b"],), (["  "],)]


@pytest.mark.parametrize("k", [1, 2, 5])
def test_greedy_folds_like_one_by_one(spark, k):
    """Many groups of few sizes, some empty: places in runs of equal sizes give what dealing one by one gives."""
    rng = np.random.default_rng(k)
    sizes = {f"g{i:03}": int(rng.choice([0, 1, 1, 2, 3, 3, 7, 50, 51])) for i in range(300)} | {"big": 400}
    weight, want = [0] * k, {}
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        want[name] = weight.index(min(weight))
        weight[want[name]] += n
    found = sampling.greedy_folds(spark.createDataFrame(list(sizes.items()), "g string, n long"), "g", "n", k)
    assert {r.g: r.fold for r in found.collect()} == want
    assert sampling.greedy_folds(spark.createDataFrame([], "g string, n long"), "g", "n", k).collect() == []


def test_archives_and_tables(spark, tmp_path):
    np.savez(tmp_path / "f.npz", case_id=np.array(["a", "b"]), n_tok=np.array([1, 2], np.int32), block=np.arange(8, dtype=np.float16).reshape(2, 2, 2), unused=np.zeros(2))
    got = archives.read_npz(spark, str(tmp_path), {"case_id": "string", "n_tok": "int"}, {"block": "double"}).orderBy("row_ord").collect()
    assert [(r.case_id, r.n_tok, r.block) for r in got] == [("a", 1, [0.0, 1.0, 2.0, 3.0]), ("b", 2, [4.0, 5.0, 6.0, 7.0])]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("results/x/data.txt", "hi")
        z.writestr("other.txt", "no")
    assert [(r.member, bytes(r.content)) for r in archives.read_zip_members(spark, str(tmp_path), r"results/\w+/data\.txt").collect()] == [("results/x/data.txt", b"hi")]
    (tmp_path / "cases.jsonl").write_text('{"case_id": "c", "answer": "A. B.", "sent_spans": [[0, 2], [3, 5]]}\n')
    assert tables.read_cases(spark, str(tmp_path / "cases.jsonl")).first().sent_spans[1].start == 3
    (tmp_path / "s.csv").write_text('case_id,sent_idx,source_id,label,n_tok,mean_surprisal,gap,chunk_drops\nc,0,s,1,4,1.5,NaN,"[1, null, -2]"\nc,1,s,0,4,2.0,0.5,[]\n')
    first, second = tables.with_signals(tables.read_sentences(spark, str(tmp_path / "s.csv"))).orderBy("sent_idx").collect()
    assert (first.gap, first.prior_logprob, first.min_drop, first.sum_drop) == (None, None, -2.0, 2.0) and (second.prior_logprob, second.min_drop) == (-2.5, None)


def test_streams(spark, tmp_path):
    from plumbline import streaming

    rows = [(i % 3, datetime(2024, 1, 1, i // 6, i % 6 * 10), "v", float(i)) for i in range(12)]
    spark.createDataFrame(rows, "k int, ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = streaming.sliding_costs(stream).writeStream.format("memory").queryName("costs").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("costs").agg(F.sum("n")).first()[0] == 18  # windows of 30 minutes every 20 hold each row once or twice
    streaming.append_batches(streaming.first_arrivals(stream, "k"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_displaced_rows_per_text_are_never_broadcast(spark, tmp_path, monkeypatch):
    from plumbline.operators import sampling
    from plumbline.plans import windows

    docs = [(i, f"s{i % 3}", " ".join(["w"] * (700 + i % 5)), 1_400) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, source string, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    plans, real = [], sampling.written
    told = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(sampling, "written", lambda df: plans.append(told(df)) or real(df))
    found = windows.displaced_text(spark, str(tmp_path))
    assert len(plans) >= 3 and found.count() == 60
    # what is joined by places and ids has a row per text or more; tables per part stay small
    for plan in [*plans, told(found)]:
        assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and ("[part#" not in x or "at#" in x)]


def test_displaced_prefix_limits_cases_not_donors(spark, tmp_path):
    from plumbline.plans import windows

    sizes = [100, 700, 1800, 1801, 3000, 0, 50, 1200, 20, 2500] + [3] * 60
    rows = [(i, " ".join(["w"] * n), f"s{i % 3}", max(2 * n - 1, 0)) for i, n in enumerate(sizes)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for a, n in enumerate(sizes):
        if 0 < n <= 1800:
            ring = sorted((b for b in range(len(sizes)) if sizes[b] and (a - b) % 2 == 0), key=lambda b: (b * 7919 % 1_000_003, b))
            start = (a * 1_103_515_245 + 12_345) % 2_147_483_648 // 65_536 % len(ring)
            before = 0
            for b in ring[start:] + ring[:start]:
                if (a - b) % 3 and before < 1808:
                    want.add((a, b, before, min(sizes[b], 1808 - before)))
                    before += sizes[b]
    assert {w[0] for w in want} >= {1, 2, 7} and {w[1] for w in want} >= {3, 4}
    assert set(one(windows.displaced_prefix(spark, str(tmp_path)))) == want


def test_sinks_and_logs(spark, tmp_path):
    """Every sink is read back by its scan."""
    df = spark.createDataFrame([(1, "m1", 0.5), (2, "m2", None)], "id int, model string, s double")
    at = lambda n: str(tmp_path / n)
    tables.write_block(df, at("block"), "model")
    tables.write_block(df.where("id = 1").withColumn("s", F.lit(9.0)), at("block"), "model")  # replaces its own partition alone
    assert sorted(one(spark.read.parquet(at("block")).select("id", "s"))) == [(1, 9.0), (2, None)]
    tables.write_once(df, at("once/features_a.parquet"))
    tables.write_once(df.limit(0), at("once/features_a.parquet"))
    assert tables.read_runs(spark, at("once"), "*.parquet").count() == 2
    tables.write_scores(df, at("scores"))
    assert any(f.name.endswith(".csv.gz") for f in (tmp_path / "scores").iterdir())
    assert sorted(one(spark.read.schema(df.schema).csv(at("scores"), header=True))) == sorted(one(df), key=str)
    tables.append_log(spark.createDataFrame([("a_x_K5", "a", "x", 2.0, None), ("b_x_K5", "b", "x", 1.0, 5)], "tag string, model string, dataset string, minutes double, max_cases int"), at("log"))
    tables.append_log(spark.createDataFrame([("c_y_K5", "c", "y", 3.0, 0)], "tag string, model string, dataset string, minutes double, max_cases int"), at("log"))
    assert sorted(r.tag for r in tables.read_run_log(spark, at("log")).collect()) == ["a_x_K5", "c_y_K5"]
    nested = df.select(F.struct("id", F.struct("s").alias("inner")).alias("report"))
    tables.write_report(nested, at("report"))
    assert sorted(r[0] for r in tables.read_report(spark, at("report"), "report struct<id: int, inner: struct<s: double>>").select("report.id").collect()) == [1, 2]
    both = tables.union_runs([df, df.select("id", F.lit(1).alias("extra"))])
    assert both.columns == ["id", "model", "s", "extra"] and both.count() == 4 and both.where("extra is null").count() == 2
    text = tables.render_markdown(df.orderBy("id"))
    assert text.split("\n") == ["| id | model | s |", "| --- | --- | --- |", "| 1 | m1 | 0.5 |", "| 2 | m2 |  |"]
    assert sorted(r.path.rsplit("/", 1)[1] for r in tables.tagged(spark.createDataFrame([("/r/a_x_K5",), ("/r/b_y_K5",), ("/r/zz",)], "path string"), "path", dataset="x").collect()) == ["a_x_K5"]


def test_digests_and_members(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one")
    (tmp_path / "b.bin").write_bytes(b"two")
    found = archives.digests(spark, str(tmp_path), "*.bin")
    pins = {r.path.rsplit("/", 1)[1]: r.digest for r in found.collect()}
    assert len(set(pins.values())) == 2 and archives.pinned(found, pins).count() == 2
    with pytest.raises(Exception, match="digest of a.bin"):
        archives.pinned(found, pins | {"a.bin": "0"}).collect()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("results/x/data.txt", "hi")
        z.writestr("results/y/data.txt", "ho")
    members = archives.read_zip_members(spark, str(tmp_path), r"results/\w+/data\.txt").select("member", "content", "digest")
    target = str(tmp_path / "kept")
    assert archives.add_members(members, target) == 2 and archives.add_members(members, target) == 0
    assert spark.read.parquet(target).count() == 2
    with pytest.raises(ValueError, match="results/x/data.txt"):
        archives.add_members(members.withColumn("digest", F.lit("other")), target)


def test_config(tmp_path):
    from plumbline.sources.config import Config

    assert Config().width == 1800 and Config().replaced(width=512, models=["m"]).models == ("m",)
    (tmp_path / "c.json").write_text('{"params": {"width": 900, "seed": 7}, "models": ["a", "b"]}')
    c = Config.read(str(tmp_path / "c.json"))
    assert (c.width, c.seed, c.models) == (900, 7, ("a", "b"))
    with pytest.raises(ValueError, match="wide"):
        Config().replaced(wide=1)


def test_places_in_groups(spark):
    """Rows of a group of any size, with null keys and repeated rows, are numbered in order."""
    rng = np.random.default_rng(1)
    rows = [(None if g == "z" else str(g), None if v > 90 else int(v)) for g, v in zip(rng.choice(["a", "b", "c", "z"], 500, p=[0.7, 0.1, 0.1, 0.1]), rng.integers(0, 100, 500))] + [("a", 5)] * 300
    found = ranks.placed(spark.createDataFrame(rows, "g string, v int").repartition(6), ["g"], ["v"]).collect()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in found if r.g == g), key=lambda r: r.at)
        values = sorted((v for k, v in rows if k == g), key=lambda v: (v is not None, v or 0))
        assert [r.at for r in own] == list(range(len(values))) and [r.v for r in own] == values and {r["size"] for r in own} == {len(values)}


def test_containing_like_all_pairs(spark):
    """Passages of any length, of parts of words, with common runs, twice in the table and empty."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["aa", "ab", "b", "é", "the"], rng.integers(0, 40))) for _ in range(60)] + ["", "x", "the\tthe the\nthe the"]
    cut = [t[a : a + n] for t in texts for a, n in [(rng.integers(0, max(len(t), 1)), rng.integers(0, 30))]]
    passages = [*cut, "the the the the the", "nowhere to be seen at all", "b", "", "a", "b é", cut[3]]
    got = matching.containing(spark.createDataFrame(list(enumerate(texts)), "doc_id int, t string"), spark.createDataFrame(list(enumerate(passages)), "item_id int, text string"))
    want = {(d, i): t.index(p) + 1 for d, t in enumerate(texts) for i, p in enumerate(passages) if p and p in t}
    assert {(r.doc_id, r.item_id): r.place for r in got.collect()} == want and got.count() == len(want)
    none = spark.createDataFrame([], "item_id int, text string")
    assert matching.containing(spark.createDataFrame([(1, "a")], "doc_id int, t string"), none).collect() == []
