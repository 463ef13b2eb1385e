"""AUC by group, precision, bootstrap intervals and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalar import rounded, safe_share, verdict
from plumbline.operators import bootstrap
from plumbline.operators.metrics import auc, auc_over, average_precision, directed_auc
from plumbline.plans.assembly import BASE, base
from plumbline.plans.registry import query, table

AUC = "(sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / nullif(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0), 0)::DOUBLE"


def ranked(keys: str, source: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return f"(SELECT *, rank() OVER ({part} ORDER BY s) + (count(*) OVER (PARTITION BY {keys + ', ' if keys else ''}s) - 1) / 2.0 AS rk FROM {source})"


def scored(spark: SparkSession, sf_dir: str, *places: int) -> DataFrame:
    df = base(spark, sf_dir)
    return df.select("doc_id", "source", "lang", "n_chars", F.col("label").alias("y"), *[F.col("x")[p].cast("double").alias(f"s{p}") for p in places])


@query(f"WITH {BASE}, t AS (SELECT lang, label AS y, x[1]::DOUBLE AS s FROM base) SELECT lang, round({AUC}, 6) + 0.0 AS auc, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg FROM {ranked('lang', 't')} GROUP BY lang HAVING sum(y) >= 3 AND sum(1 - y) >= 3")
def auc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector AUC by group with a minimum of both classes. The flagship query."""
    found = auc(scored(spark, sf_dir, 0), ["lang"], "s0", "y").where("n_pos >= 3 and n_neg >= 3")
    return found.withColumn("auc", rounded(F.col("auc")))


LINES = "t AS (SELECT l_returnflag, l_linenumber, l_discount AS s, (l_linestatus = 'F')::INT AS y FROM lineitem)"


@query(f"""WITH {LINES}, g AS (SELECT 'all' AS grouping, 'all' AS member, s, y FROM t UNION ALL SELECT 'l_returnflag', l_returnflag, s, y FROM t UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, s, y FROM t)
    SELECT grouping, member, round({AUC}, 6) + 0.0 AS auc, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg FROM {ranked('grouping, member', 'g')} GROUP BY 1, 2""")
def auc_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", F.col("l_discount").alias("s"), (F.col("l_linestatus") == "F").cast("int").alias("y"))
    return auc_over(df, [[], ["l_returnflag"], ["l_linenumber"]], "s", "y").withColumn("auc", rounded(F.col("auc")))


@query(f"""WITH {LINES}, c AS (SELECT l_linenumber AS k, s, sum(y) AS p, count(*) AS n FROM t GROUP BY 1, 2),
    r AS (SELECT k, p, sum(p) OVER (PARTITION BY k ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY k ORDER BY s DESC) AS n FROM c) SELECT k::BIGINT AS k, round(sum(p * tp / n::DOUBLE) / sum(p), 6) + 0.0 AS ap FROM r GROUP BY k""")
def average_precision_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("k"), F.col("l_discount").alias("s"), (F.col("l_linestatus") == "F").cast("int").alias("y"))
    return average_precision(df, ["k"], "s", "y").withColumn("ap", rounded(F.col("ap")))


@query(f"""WITH {BASE}, l AS (SELECT doc_id % 2 = 0 AS dev, label AS y, unnest(x)::DOUBLE AS s, generate_subscripts(x, 1) AS f FROM base), a AS (SELECT dev, f, {AUC} AS auc FROM {ranked('dev, f', 'l')} GROUP BY 1, 2)
    SELECT d.f::BIGINT AS f, round(d.auc, 6) + 0.0 AS dev_auc, round(CASE WHEN d.auc < 0.5 THEN 1 - t.auc ELSE t.auc END, 6) + 0.0 AS auc FROM a d JOIN a t ON d.f = t.f AND d.dev AND NOT t.dev""")
def raw_auc_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All single features at once in long form; the sign comes from the development half."""
    each = base(spark, sf_dir).select("doc_id", F.col("label").alias("y"), F.posexplode("x").alias("p", "w"))
    rows = each.select("doc_id", "y", (F.col("p") + 1).cast("long").alias("f"), F.col("w").cast("double").alias("s"))
    found = directed_auc(rows, F.col("doc_id") % 2 == 0, ["f"], "s", "y")
    return found.select("f", rounded(F.col("dev_auc")).alias("dev_auc"), rounded(F.col("auc")).alias("auc"))


@query(f"""WITH {BASE}, e AS (SELECT quantile_cont(n_chars, [0, 0.25, 0.5, 0.75, 1]) AS q FROM base), t AS (SELECT greatest(1, len(list_filter(list_distinct(q), lambda v: v < n_chars)))::BIGINT AS bin, label AS y, x[2]::DOUBLE AS s, n_chars FROM base, e)
    SELECT bin, round({AUC}, 6) + 0.0 AS auc, count(*) AS n, min(n_chars) || '..' || max(n_chars) AS span, round(avg(y), 6) + 0.0 AS rate FROM {ranked('bin', 't')} GROUP BY bin""")
def auc_by_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.operators.bins import quantile_bins

    binned = quantile_bins(scored(spark, sf_dir, 1), [], "n_chars", 4)
    about = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.concat_ws("..", F.min("n_chars").cast("string"), F.max("n_chars").cast("string")).alias("span"), rounded(F.avg("y")).alias("rate"))
    return about.join(auc(binned, ["bin"], "s1", "y"), "bin").select("bin", rounded(F.col("auc")).alias("auc"), "n", "span", "rate")


REPLICATES = 2000
BOOT = f"""{BASE}, t AS (SELECT source AS c, label AS y, x[1]::DOUBLE AS a, x[2]::DOUBLE AS b FROM base), s AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT c FROM t)),
    k AS (SELECT b AS r, (b * 7368787 + k * 1299721 + 42) % 2147483647 AS x0, (x0 * x0 + 69621) % 2147483647 AS x1, (x1 * 48271 + 11) % 2147483647 AS x2, (x2 * x2 + 7) % 2147483647 AS x3, (x3 * 16807 + 3) % 2147483647 * m // 2147483647 AS i
        FROM (SELECT unnest(range({REPLICATES})) AS b), (SELECT unnest(range(max(m))) AS k, max(m) AS m FROM s)),
    w AS (SELECT r, c, count(*) AS w FROM k JOIN s USING (i) GROUP BY 1, 2),
    u AS (SELECT p.c AS s, n.c AS t, sum((p.a > n.a)::INT + 0.5 * (p.a = n.a)::INT) AS ua, sum((p.b > n.b)::INT + 0.5 * (p.b = n.b)::INT) AS ub, count(*) AS pairs FROM t p JOIN t n ON p.y = 1 AND n.y = 0 GROUP BY 1, 2),
    d AS (SELECT w1.r, sum((ua - ub) * w1.w * w2.w) / sum(pairs * w1.w * w2.w)::DOUBLE AS d FROM u JOIN w w1 ON w1.c = u.s JOIN w w2 ON w2.c = u.t AND w2.r = w1.r GROUP BY 1)"""


@query(f"""WITH {BOOT} SELECT round(avg(d), 6) + 0.0 AS mean, round(quantile_cont(d, 0.025), 6) + 0.0 AS lo, round(quantile_cont(d, 0.975), 6) + 0.0 AS hi, round(avg((d <= 0)::INT), 6) + 0.0 AS p_le0, count(*) AS n,
    quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS significant FROM d""")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired bootstrap over sources of the AUC difference of two detectors."""
    df = scored(spark, sf_dir, 0, 1)
    weights = bootstrap.draw_weights(spark, df.select(F.col("source").alias("cluster")).distinct(), REPLICATES)
    out = bootstrap.interval(bootstrap.paired_differences(df, [], "source", "s0", "s1", "y", weights, REPLICATES))
    return out.select(*[rounded(F.col(c)).alias(c) for c in ("mean", "lo", "hi", "p_le0")], "n", "significant")


@query(f"""WITH {BOOT}, u2 AS (SELECT p.c AS s, n.c AS t, sum((p.b > n.b)::INT + 0.5 * (p.b = n.b)::INT) - sum((p.a > n.a)::INT + 0.5 * (p.a = n.a)::INT) AS g, count(*) AS pairs FROM t p JOIN t n ON p.y = 1 AND n.y = 0 WHERE p.c > 'src14' AND n.c > 'src14' GROUP BY 1, 2),
    d2 AS (SELECT w1.r, sum(g * w1.w * w2.w) / sum(pairs * w1.w * w2.w)::DOUBLE AS d FROM u2 JOIN w w1 ON w1.c = u2.s JOIN w w2 ON w2.c = u2.t AND w2.r = w1.r GROUP BY 1),
    m AS (SELECT r, avg(d) AS d FROM (SELECT * FROM d UNION ALL SELECT * FROM d2) GROUP BY r),
    pt AS (SELECT ((SELECT sum(ua - ub) / sum(pairs) FROM u) + (SELECT sum(g) / sum(pairs) FROM u2)) / 2 AS p)
    SELECT round(p, 6) + 0.0 AS point, round(quantile_cont(d, 0.025), 6) + 0.0 AS lo, round(quantile_cont(d, 0.975), 6) + 0.0 AS hi,
    CASE WHEN quantile_cont(d, 0.025) > 0 THEN 'ahead' WHEN quantile_cont(d, 0.975) < 0 THEN 'behind' ELSE 'tie' END AS verdict FROM m, pt GROUP BY p""")
def pooled_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs pooled: the same draw of sources for both, a source that a run lacks is skipped, the point estimate is of the unresampled rows."""
    df = scored(spark, sf_dir, 0, 1)
    runs = [(df, "s0", "s1"), (df.where("source > 'src14'"), "s1", "s0")]
    weights = bootstrap.draw_weights(spark, df.select(F.col("source").alias("cluster")).distinct(), REPLICATES)
    both = [d.select("source", "y", F.lit(i).alias("run"), F.col(a).alias("a"), F.col(b).alias("b_")) for i, (d, a, b) in enumerate(runs)]
    diffs = bootstrap.paired_differences(both[0].unionByName(both[1]), ["run"], "source", "a", "b_", "y", weights, REPLICATES)
    pooled = diffs.groupBy("b").agg(F.avg("diff").alias("diff"))
    points = [auc(d, [], a, "y").select(F.col("auc").alias("p")).unionByName(auc(d, [], b, "y").select((-F.col("auc")).alias("p"))) for d, a, b in runs]
    point = points[0].unionByName(points[1]).agg((F.sum("p") / 2).alias("point"))
    out = bootstrap.interval(pooled).join(F.broadcast(point))  # two single rows
    return out.select(rounded(F.col("point")).alias("point"), rounded(F.col("lo")).alias("lo"), rounded(F.col("hi")).alias("hi"), verdict(F.col("lo"), F.col("hi")).alias("verdict"))


@query(f"""WITH {BASE}, l AS (SELECT source, label AS y, f, x[f]::DOUBLE AS s FROM base, (SELECT unnest([1, 2, 3]) AS f)), a AS (SELECT source, f, {AUC} AS auc FROM {ranked('source, f', 'l')} GROUP BY 1, 2)
    SELECT b.source, round(CASE WHEN abs(f.auc - w.auc) > 1e-3 THEN (b.auc - w.auc) / (f.auc - w.auc) END, 6) + 0.0 AS recovered, b.auc - w.auc > -0.01 AND b.auc > 0.5 AS accepted FROM a w JOIN a b ON b.source = w.source AND w.f = 1 AND b.f = 2 JOIN a f ON f.source = w.source AND f.f = 3 WHERE b.auc IS NOT NULL""")
def recovered_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a loss that a method recovers, and a composite rule, per source."""
    each = base(spark, sf_dir).select("source", F.col("label").alias("y"), F.posexplode(F.slice("x", 1, 3)).alias("f", "w")).withColumn("s", F.col("w").cast("double"))
    wide = auc(each, ["source", "f"], "s", "y").groupBy("source").pivot("f", [0, 1, 2]).agg(F.first("auc")).where("`1` is not null")
    w, b, f = F.col("0"), F.col("1"), F.col("2")
    return wide.select("source", rounded(safe_share(b - w, f - w)).alias("recovered"), ((b - w > -0.01) & (b > 0.5)).alias("accepted"))
