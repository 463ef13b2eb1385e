"""The data behind reports: pivots, cost tables, distributions, seed robustness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import rounded, safe_share
from plumbline.operators import bins, bootstrap
from plumbline.operators.lineage import written
from plumbline.operators.matching import containing
from plumbline.operators.metrics import auc
from plumbline.operators.quantiles import with_order_statistics
from plumbline.operators.sampling import lcg, random_folds
from plumbline.plans.assembly import BASE, base
from plumbline.plans.evaluation import AUC, BOOT, REPLICATES, ranked, scored
from plumbline.plans.registry import query, table


@query("""SELECT user_id % 7 AS model, round(avg(value) FILTER (WHERE event_type = 'click'), 6) + 0.0 AS click, round(avg(value) FILTER (WHERE event_type = 'view'), 6) + 0.0 AS "view", round(avg(value) FILTER (WHERE event_type = 'purchase'), 6) + 0.0 AS purchase FROM events GROUP BY 1""")
def cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean seconds by model and method: a pivot with its values listed."""
    e = table(spark, sf_dir, "events")
    wide = e.groupBy((F.col("user_id") % 7).alias("model")).pivot("event_type", ["click", "view", "purchase"]).agg(F.avg("value"))
    return wide.select("model", *[rounded(F.col(c)).alias(c) for c in ("click", "view", "purchase")])


@query("""SELECT bin, count(*) AS n, median(value) AS middle, max(value) AS most FROM (SELECT value, CASE WHEN value > 0 AND value <= 10 THEN 0 WHEN value > 10 AND value <= 50 THEN 1 WHEN value > 50 AND value <= 1000 THEN 2 END::BIGINT AS bin FROM events) GROUP BY bin""")
def cost_by_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("value", bins.cut(F.col("value"), [0, 10, 50, 1000]).alias("bin"))
    found = e.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))
    return with_order_statistics(found, e, ["bin"], "value", [0.5], ["middle"])


PIVOT = f"{BASE}, l AS (SELECT lang, f, label AS y, x[f]::DOUBLE AS s FROM base, (SELECT unnest([1, 2, 3]) AS f)), a AS (SELECT lang, f, {AUC} AS auc FROM {ranked('lang, f', 'l')} GROUP BY 1, 2)"


@query(f"WITH {PIVOT} SELECT lang, round(max(auc) FILTER (WHERE f = 1), 6) + 0.0 AS d1, round(max(auc) FILTER (WHERE f = 2), 6) + 0.0 AS d2, round(max(auc) FILTER (WHERE f = 3), 6) + 0.0 AS d3 FROM a GROUP BY lang")
def pivot_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors as columns: scores are unpivoted once, every AUC shares one ordering."""
    long_ = scored(spark, sf_dir, 0, 1, 2).unpivot(["lang", "y"], ["s0", "s1", "s2"], "f", "s")
    wide = auc(long_, ["lang", "f"], "s", "y").groupBy("lang").pivot("f", ["s0", "s1", "s2"]).agg(F.first("auc"))
    return wide.select("lang", *[rounded(F.col(f"s{i}")).alias(f"d{i + 1}") for i in range(3)])


@query(f"""WITH {BASE}, l AS (SELECT (f - 1) // 8 AS layer, label AS y, x[f]::DOUBLE AS v, doc_id FROM base, (SELECT unnest(range(1, 65)) AS f)), m AS (SELECT layer, doc_id, y, round(avg(v), 9) AS s FROM l GROUP BY 1, 2, 3),
    a AS (SELECT layer, {AUC} AS auc FROM {ranked('layer', 'm')} GROUP BY 1)
    SELECT layer::BIGINT AS layer, round(auc, 6) + 0.0 AS auc, round(avg(auc) OVER (ORDER BY layer ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) + 0.0 AS smooth, row_number() OVER (ORDER BY round(auc, 9) DESC, layer) = 1 AS best FROM a""")
def layer_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC per layer, smoothed over three layers, and the best layer."""
    each = base(spark, sf_dir).select("doc_id", F.col("label").alias("y"), F.posexplode("x").alias("p", "w"))
    means = each.groupBy(F.floor(F.col("p") / 8).alias("layer"), "doc_id", "y").agg(F.round(F.avg(F.col("w").cast("double")), 9).alias("s"))
    curve = bins.smoothed(auc(means, ["layer"], "s", "y").select("layer", "auc"), [], "layer", "auc", "smooth")  # one row per layer
    best = F.row_number().over(Window.orderBy(F.desc(F.round("auc", 9)), "layer")) == 1
    return curve.select("layer", rounded(F.col("auc")).alias("auc"), rounded(F.col("smooth")).alias("smooth"), best.alias("best"))


@query("""SELECT event_type, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS part, count(DISTINCT user_id) AS n_users, sum((value > 50)::INT)::BIGINT AS n_high, median(value) AS middle, round(stddev_pop(value), 6) + 0.0 AS sd0, round(stddev_samp(value), 6) + 0.0 AS sd1 FROM events GROUP BY event_type""")
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    g = e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"), F.count_if(F.col("value") > 50).alias("n_high"), rounded(F.stddev_pop("value")).alias("sd0"), rounded(F.stddev_samp("value")).alias("sd1")
    )
    g = with_order_statistics(g, e, ["event_type"], "value", [0.5], ["middle"])
    return g.withColumn("part", F.col("n") / F.sum("n").over(Window.partitionBy()).cast("double"))


@query(f"""WITH {BASE}, l AS (SELECT seed, lang, label AS y, x[1]::DOUBLE AS s FROM base, (SELECT unnest([1, 2, 3, 4, 5]) AS seed) WHERE ((doc_id * 31 + seed * 1009) * 1103515245 + 12345) % 2147483648 // 65536 % 4 <> 0),
    a AS (SELECT seed, {AUC} AS auc FROM {ranked('seed', 'l')} GROUP BY seed) SELECT count(*) AS n, round(avg(auc), 6) + 0.0 AS mean, round(min(auc), 6) + 0.0 AS low, round(max(auc), 6) + 0.0 AS high, sum((auc > 0.5)::INT)::BIGINT AS above FROM a""")
def seed_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same metric over seeded subsets: mean, range and how often it is above chance."""
    each = scored(spark, sf_dir, 0).withColumn("seed", F.explode(F.array(*[F.lit(i).cast("long") for i in range(1, 6)])))
    kept = each.where(lcg(F.col("doc_id") * 31 + F.col("seed") * 1009) % 4 != 0)
    a = auc(kept, ["seed"], "s0", "y")
    return a.agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("auc")).alias("mean"), rounded(F.min("auc")).alias("low"), rounded(F.max("auc")).alias("high"), F.count_if(F.col("auc") > 0.5).alias("above"))


@query(f"""WITH {BASE} SELECT lang, count(*) AS n_rows, count(*) FILTER (WHERE n_chars > 2000) AS n_cut, count(DISTINCT source) AS n_sources, round(avg(label), 6) + 0.0 AS rate FROM base GROUP BY lang""")
def power_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n_chars") > 2000).alias("n_cut"), F.countDistinct("source").alias("n_sources"), rounded(F.avg("label")).alias("rate"))


DEV = "doc_id % 2 = 0"


def split_auc(where: str) -> str:
    return f"(SELECT lang, f, {AUC} AS auc FROM {ranked('lang, f', f'(SELECT lang, f, label AS y, x[f]::DOUBLE AS s FROM base, (SELECT unnest([1, 2, 3]) AS f) WHERE {where})')} GROUP BY 1, 2)"


@query(f"""WITH {BASE} SELECT t.lang, t.f::BIGINT AS f, round(d.auc, 6) + 0.0 AS dev, round(t.auc, 6) + 0.0 AS test FROM {split_auc('NOT ' + DEV)} t JOIN {split_auc(DEV)} d ON d.lang = t.lang AND d.f = t.f""")
def dev_test_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The development value beside that on the test rows, which are none of them."""
    long_ = scored(spark, sf_dir, 0, 1, 2).unpivot(["lang", "y", "doc_id"], ["s0", "s1", "s2"], "f", "s").withColumn("f", F.substring("f", 2, 1).cast("long") + 1)
    dev = auc(long_.where(DEV), ["lang", "f"], "s", "y").select("lang", "f", rounded(F.col("auc")).alias("dev"))
    return auc(long_.where(f"not {DEV}"), ["lang", "f"], "s", "y").join(dev, ["lang", "f"]).select("lang", "f", "dev", rounded(F.col("auc")).alias("test"))


@query(f"""WITH {BASE}, l AS (SELECT 'span' AS level, 'all' AS rows, lang, f, label AS y, x[f]::DOUBLE AS s FROM base, (SELECT unnest([1, 2, 3]) AS f)),
    r AS (SELECT 'response' AS level, 'all' AS rows, lang, f, max(label) AS y, max(x[f]::DOUBLE) AS s FROM base, (SELECT unnest([1, 2, 3]) AS f) GROUP BY lang, source, f),
    lt AS (SELECT 'span' AS level, 'truncated' AS rows, lang, f, label AS y, x[f]::DOUBLE AS s FROM base, (SELECT unnest([1, 2, 3]) AS f) WHERE n_chars > 2000),
    rt AS (SELECT 'response' AS level, 'truncated' AS rows, lang, f, max(label) AS y, max(x[f]::DOUBLE) AS s FROM base, (SELECT unnest([1, 2, 3]) AS f) WHERE n_chars > 2000 GROUP BY lang, source, f),
    u AS (SELECT * FROM l UNION ALL SELECT * FROM r UNION ALL SELECT * FROM lt UNION ALL SELECT * FROM rt), a AS (SELECT level, rows, lang, f, {AUC} AS auc FROM {ranked('level, rows, lang, f', 'u')} GROUP BY 1, 2, 3, 4)
    SELECT level, rows, lang, round(max(auc) FILTER (WHERE f = 1), 6) + 0.0 AS d1, round(max(auc) FILTER (WHERE f = 2), 6) + 0.0 AS d2, round(max(auc) FILTER (WHERE f = 3), 6) + 0.0 AS d3 FROM a GROUP BY 1, 2, 3""")
def detector_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of all detectors at both levels, over all and over truncated rows."""
    long_ = scored(spark, sf_dir, 0, 1, 2).unpivot(["lang", "source", "n_chars", "y"], ["s0", "s1", "s2"], "f", "s")
    parts = F.explode(F.when(F.col("n_chars") > 2000, F.array(F.lit("all"), F.lit("truncated"))).otherwise(F.array(F.lit("all")))).alias("rows")
    spans = long_.select(F.lit("span").alias("level"), parts, "lang", "source", "f", "y", "s")
    responses = spans.groupBy("rows", "lang", "source", "f").agg(F.max("y").alias("y"), F.max("s").alias("s")).withColumn("level", F.lit("response"))
    found = auc(spans.unionByName(responses), ["level", "rows", "lang", "f"], "s", "y")
    wide = found.groupBy("level", "rows", "lang").pivot("f", ["s0", "s1", "s2"]).agg(F.first("auc"))
    return wide.select("level", "rows", "lang", *[rounded(F.col(f"s{i}")).alias(f"d{i + 1}") for i in range(3)])


CUT_BOOT = BOOT.replace("t AS (SELECT source AS c, label AS y, x[1]::DOUBLE AS a, x[2]::DOUBLE AS b FROM base)", "t AS (SELECT source AS c, label AS y, x[2]::DOUBLE AS a, x[1]::DOUBLE AS b FROM base WHERE n_chars > 2000)")


@query(f"""WITH {CUT_BOOT}, l AS (SELECT f, label AS y, x[f]::DOUBLE AS s FROM base, (SELECT unnest([1, 2, 3]) AS f) WHERE n_chars > 2000), v AS (SELECT f, {AUC} AS auc FROM {ranked('f', 'l')} GROUP BY f),
    p AS (SELECT max(auc) FILTER (WHERE f = 1) AS w, max(auc) FILTER (WHERE f = 2) AS b, max(auc) FILTER (WHERE f = 3) AS f FROM v)
    SELECT (SELECT count(*) FROM t) AS n, (SELECT count(DISTINCT c) FROM t) AS n_sources, round(w, 6) + 0.0 AS window1, round(b, 6) + 0.0 AS b, round(f, 6) + 0.0 AS full_view, round(CASE WHEN abs(f - w) > 1e-3 THEN (b - w) / (f - w) END, 6) + 0.0 AS recovered,
    (SELECT round(avg(d), 6) + 0.0 FROM d) AS diff, (SELECT round(quantile_cont(d, 0.025), 6) + 0.0 FROM d) AS lo, (SELECT round(quantile_cont(d, 0.975), 6) + 0.0 FROM d) AS hi FROM p""")
def controlled_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncated rows: window 1, all windows and the full view, what of the loss is recovered, and the interval of the difference."""
    df = scored(spark, sf_dir, 0, 1, 2).where("n_chars > 2000")
    weights = bootstrap.draw_weights(spark, df.select(F.col("source").alias("cluster")).distinct(), REPLICATES)
    diffs = bootstrap.interval(bootstrap.paired_differences(df, [], "source", "s1", "s0", "y", weights, REPLICATES)).select(rounded(F.col("mean")).alias("diff"), rounded(F.col("lo")).alias("lo"), rounded(F.col("hi")).alias("hi"))
    wide = auc(df.unpivot(["y"], ["s0", "s1", "s2"], "f", "s"), ["f"], "s", "y").groupBy().pivot("f", ["s0", "s1", "s2"]).agg(F.first("auc"))
    about = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"))
    both = about.crossJoin(wide).crossJoin(diffs)  # single rows
    w, b, f = F.col("s0"), F.col("s1"), F.col("s2")
    return both.select("n", "n_sources", rounded(w).alias("window1"), rounded(b).alias("b"), rounded(f).alias("full_view"), rounded(safe_share(b - w, f - w)).alias("recovered"), "diff", "lo", "hi")


@query(f"""WITH {BOOT}, r AS (SELECT lang, f, {AUC} AS auc FROM {ranked('lang, f', "(SELECT lang, f, label AS y, x[f]::DOUBLE AS s FROM base, (SELECT unnest([1, 2]) AS f))")} GROUP BY 1, 2),
    g AS (SELECT a.lang, a.auc - b.auc AS diff FROM r a JOIN r b ON a.lang = b.lang AND a.f = 1 AND b.f = 2), i AS (SELECT quantile_cont(d, 0.025) AS lo FROM d)
    SELECT round(lo, 6) + 0.0 AS lo, round((SELECT min(diff) FROM g), 6) + 0.0 AS worst, lo > 0 AS rule_1, (SELECT min(diff) FROM g) >= -0.01 AS rule_2, CASE WHEN lo > 0 AND (SELECT min(diff) FROM g) >= -0.01 THEN 'becomes the method' ELSE 'stays a variant' END AS decision FROM i""")
def decision_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A composite rule: the interval over all runs above zero, and no single run worse than a hundredth."""
    df = scored(spark, sf_dir, 0, 1)
    weights = bootstrap.draw_weights(spark, df.select(F.col("source").alias("cluster")).distinct(), REPLICATES)
    lo = bootstrap.interval(bootstrap.paired_differences(df, [], "source", "s0", "s1", "y", weights, REPLICATES)).select("lo")
    runs = auc(df.unpivot(["lang", "y"], ["s0", "s1"], "f", "s"), ["lang", "f"], "s", "y").groupBy("lang").pivot("f", ["s0", "s1"]).agg(F.first("auc"))
    worst = runs.agg(F.min(F.col("s0") - F.col("s1")).alias("worst"))
    first, second = F.col("lo") > 0, F.col("worst") >= -0.01
    both = lo.crossJoin(worst)  # single rows
    return both.select(rounded(F.col("lo")).alias("lo"), rounded(F.col("worst")).alias("worst"), first.alias("rule_1"), second.alias("rule_2"), F.when(first & second, "becomes the method").otherwise("stays a variant").alias("decision"))


@query(f"""WITH {BOOT}, m AS (SELECT d.doc_id, position(b.text IN d.text) - 1 AS place, length(left(d.text, 3000)) AS window_end FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
    g AS (SELECT base.doc_id, source, label AS y, x[1]::DOUBLE AS w, x[2]::DOUBLE AS b, CASE WHEN count(place) = 0 THEN 'none' WHEN avg((place >= window_end)::INT) = 0 THEN 'in window 1' WHEN avg((place >= window_end)::INT) = 1 THEN 'all out' ELSE 'partly out' END AS kind FROM base LEFT JOIN m USING (doc_id) GROUP BY 1, 2, 3, 4, 5),
    gu AS (SELECT p.kind, p.source AS s, n.source AS t, sum((p.b > n.b)::INT + 0.5 * (p.b = n.b)::INT) - sum((p.w > n.w)::INT + 0.5 * (p.w = n.w)::INT) AS gain, count(*) AS pairs FROM g p JOIN g n ON p.kind = n.kind AND p.y = 1 AND n.y = 0 GROUP BY 1, 2, 3),
    gd AS (SELECT kind, w1.r, sum(gain * w1.w * w2.w) / sum(pairs * w1.w * w2.w)::DOUBLE AS d FROM gu JOIN w w1 ON w1.c = gu.s JOIN w w2 ON w2.c = gu.t AND w2.r = w1.r GROUP BY 1, 2),
    gi AS (SELECT kind, round(quantile_cont(d, 0.025), 6) + 0.0 AS lo, round(quantile_cont(d, 0.975), 6) + 0.0 AS hi FROM gd GROUP BY kind),
    l AS (SELECT kind, f, y, CASE WHEN f = 1 THEN w ELSE b END AS s FROM g, (SELECT unnest([1, 2]) AS f)), a AS (SELECT kind, f, {AUC} AS auc, count(*) AS n FROM {ranked('kind, f', 'l')} GROUP BY 1, 2)
    SELECT kind, max(n) AS n, round(max(auc) FILTER (WHERE f = 1), 6) + 0.0 AS window1, round(max(auc) FILTER (WHERE f = 2), 6) + 0.0 AS b, any_value(lo) AS lo, any_value(hi) AS hi FROM a LEFT JOIN gi USING (kind) GROUP BY kind""")
def evidence_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of both readings by where the evidence stands, with the interval of their difference per group."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    found = containing(docs, table(spark, sf_dir, "benchmark")).select("doc_id", (F.col("place") - 1 >= F.length(F.left("t", F.lit(3000)))).cast("double").alias("out"))
    beyond = found.groupBy("doc_id").agg(F.avg("out").alias("beyond"))
    kind = F.when(F.col("beyond").isNull(), "none").when(F.col("beyond") == 0, "in window 1").when(F.col("beyond") == 1, "all out").otherwise("partly out")
    rows = written(scored(spark, sf_dir, 0, 1).join(beyond, "doc_id", "left").withColumn("kind", kind))
    each = auc(rows.unpivot(["kind", "y"], ["s0", "s1"], "f", "s"), ["kind", "f"], "s", "y")
    wide = each.groupBy("kind").pivot("f", ["s0", "s1"]).agg(F.first("auc"))
    weights = bootstrap.draw_weights(spark, rows.select(F.col("source").alias("cluster")).distinct(), REPLICATES)
    limits = bootstrap.interval(bootstrap.paired_differences(rows, ["kind"], "source", "s1", "s0", "y", weights, REPLICATES), "kind").select("kind", rounded(F.col("lo")).alias("lo"), rounded(F.col("hi")).alias("hi"))
    sizes = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(wide, "kind").join(limits, "kind", "left").select("kind", "n", rounded(F.col("s0")).alias("window1"), rounded(F.col("s1")).alias("b"), "lo", "hi")


@query(f"""WITH {BASE}, r AS (SELECT lang, label AS y, x[1]::DOUBLE AS s, row_number() OVER (PARTITION BY lang ORDER BY x[4]::DOUBLE, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM base),
    t AS (SELECT lang, y, s, 1 + (3 * (r - 1) > n - 1)::BIGINT + (3 * (r - 1) > 2 * (n - 1))::BIGINT AS bin FROM r), a AS (SELECT lang, bin, {AUC} AS auc, count(*) AS n FROM {ranked('lang, bin', 't')} GROUP BY 1, 2)
    SELECT lang, bin, ['low', 'mid', 'high'][bin] AS name, n, round(auc, 6) + 0.0 AS auc FROM a""")
def prior_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC by tertile of the prior, in the order low, mid, high."""
    rows = bins.tertiles(scored(spark, sf_dir, 0, 3), ["lang"], "s3", ("doc_id",), "bin")
    sizes = rows.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    name = F.element_at(F.array(F.lit("low"), F.lit("mid"), F.lit("high")), F.col("bin").cast("int"))
    return auc(rows, ["lang", "bin"], "s0", "y").join(sizes, ["lang", "bin"]).select("lang", "bin", name.alias("name"), "n", rounded(F.col("auc")).alias("auc"))


SHORT = "regexp_replace(printf('%.3f', {}), '^(-?)0\\.', '\\1.')"


@query(f"""WITH {BASE}, l AS (SELECT CASE WHEN {DEV} THEN 'dev' ELSE 'test' END AS split, lang, source, f, label AS y, x[f]::DOUBLE AS s FROM base, (SELECT unnest([1, 2, 3]) AS f) WHERE n_chars > 1000),
    a AS (SELECT split, lang, f, round({AUC}, 6) AS auc, count(*) AS n, count(DISTINCT source) AS k FROM {ranked('split, lang, f', 'l')} GROUP BY 1, 2, 3),
    w AS (SELECT split, lang, max(n) AS n, max(k) AS k, max(auc) FILTER (WHERE f = 1) AS w, max(auc) FILTER (WHERE f = 2) AS b, max(auc) FILTER (WHERE f = 3) AS l FROM a GROUP BY 1, 2)
    SELECT lang, split, n || ' / ' || k AS size, {SHORT.format('w')} || ' / ' || {SHORT.format('b')} || ' / ' || {SHORT.format('l')} AS aucs, printf('%+.3f', b - l) AS gap FROM w WHERE w IS NOT NULL""")
def paper_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Development and test rows of the appendix tables: sizes, the three readings and their gap as they are printed."""
    long_ = scored(spark, sf_dir, 0, 1, 2).where("n_chars > 1000").withColumn("split", F.when(F.expr(DEV), "dev").otherwise("test"))
    sizes = long_.groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("k"))
    each = auc(long_.unpivot(["split", "lang", "y"], ["s0", "s1", "s2"], "f", "s"), ["split", "lang", "f"], "s", "y")
    wide = each.groupBy("split", "lang").pivot("f", ["s0", "s1", "s2"]).agg(F.first(F.round("auc", 6))).where("s0 is not null").join(sizes, ["split", "lang"])
    text = lambda c: F.regexp_replace(F.format_string("%.3f", c), r"^(-?)0\.", "$1.")
    return wide.select("lang", "split", F.concat_ws(" / ", F.col("n").cast("string"), F.col("k").cast("string")).alias("size"), F.concat_ws(" / ", text("s0"), text("s1"), text("s2")).alias("aucs"), F.format_string("%+.3f", F.col("s1") - F.col("s2")).alias("gap"))


@query("""WITH w AS (SELECT user_id % 5 AS model, user_id, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT model, count(*) AS n_cases, round(avg(1 + floor(value / 50)), 6) + 0.0 AS windows FROM w JOIN events e ON e.event_id = w.first GROUP BY 1""")
def windows_per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean windows per case in two levels: the first row of a case, then the mean over cases."""
    first = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("model"), "user_id").agg(F.min_by("value", "event_id").alias("value"))
    return first.groupBy("model").agg(F.count(F.lit(1)).alias("n_cases"), rounded(F.avg(1 + F.floor(F.col("value") / 50))).alias("windows"))


@query(f"""WITH {BASE}, s AS (SELECT source, (row_number() OVER (ORDER BY md5('5:' || source), source) - 1) % 4 AS fold FROM (SELECT DISTINCT source FROM base)), l AS (SELECT fold, f, label AS y, x[f]::DOUBLE AS s FROM base JOIN s USING (source), (SELECT unnest([1, 2]) AS f)),
    a AS (SELECT fold, f, {AUC} AS auc FROM {ranked('fold, f', 'l')} GROUP BY 1, 2), w AS (SELECT x.auc AS a, y.auc AS b FROM a x JOIN a y ON x.fold = y.fold AND x.f = 1 AND y.f = 2)
    SELECT count(a) AS n, round(avg(a), 6) + 0.0 AS mean_a, round(stddev_pop(a), 6) + 0.0 AS sd_a, round(avg(b), 6) + 0.0 AS mean_b, round(stddev_pop(b), 6) + 0.0 AS sd_b, sum((a > b)::INT)::BIGINT AS a_better FROM w""")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the AUC over grouped folds, and in how many of them the first detector is better; folds of one class count nowhere."""
    df = scored(spark, sf_dir, 0, 1)
    rows = df.join(random_folds(df, "source", 4, 5), "source").unpivot(["fold", "y"], ["s0", "s1"], "f", "s")
    wide = auc(rows, ["fold", "f"], "s", "y").groupBy("fold").pivot("f", ["s0", "s1"]).agg(F.first("auc"))
    a, b = F.col("s0"), F.col("s1")
    return wide.agg(F.count(a).alias("n"), rounded(F.avg(a)).alias("mean_a"), rounded(F.stddev_pop(a)).alias("sd_a"), rounded(F.avg(b)).alias("mean_b"), rounded(F.stddev_pop(b)).alias("sd_b"), F.count_if(a > b).alias("a_better"))


@query(f"""WITH {BASE}, l AS (SELECT lang, f, label AS y, CASE WHEN f = 2 THEN -(x[f]::DOUBLE) ELSE x[f]::DOUBLE END AS s FROM base, (SELECT unnest([1, 2, 3]) AS f)) SELECT lang, f::BIGINT AS f, round({AUC}, 6) + 0.0 AS auc FROM {ranked('lang, f', 'l')} GROUP BY 1, 2""")
def signed_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC by task with signs stated beforehand: the second signal falls with the label."""
    long_ = scored(spark, sf_dir, 0, 1, 2).unpivot(["lang", "y"], ["s0", "s1", "s2"], "f", "s").withColumn("s", F.when(F.col("f") == "s1", -F.col("s")).otherwise(F.col("s")))
    found = auc(long_, ["lang", "f"], "s", "y")
    return found.select("lang", (F.substring("f", 2, 1).cast("long") + 1).alias("f"), rounded(F.col("auc")).alias("auc"))


@query("""SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) + 0.0 AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2""")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions joined onto a fact table; what is small is broadcast by its measured size."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("lineitem").where("l_shipdate >= timestamp'1995-01-01'").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    named = joined.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2) + F.lit(0.0)).alias("revenue"))


WON = "sum((p.{0} > n.{0})::INT + 0.5 * (p.{0} = n.{0})::INT) AS {0}"
#: Per split, language and replicate the AUC of three readings.
READINGS = f"""{BOOT}, z AS (SELECT CASE WHEN {DEV} THEN 'dev' ELSE 'test' END AS split, lang, source, label AS y, x[1]::DOUBLE AS w1, x[2]::DOUBLE AS b, x[3]::DOUBLE AS l FROM base WHERE n_chars > 1000),
    zu AS (SELECT p.split, p.lang, p.source AS s, n.source AS t, count(*) AS pairs, {WON.format('w1')}, {WON.format('b')}, {WON.format('l')} FROM z p JOIN z n ON p.split = n.split AND p.lang = n.lang AND p.y = 1 AND n.y = 0 GROUP BY 1, 2, 3, 4),
    zd AS (SELECT split, lang, p.r, sum(w1 * p.w * n.w) / sum(pairs * p.w * n.w)::DOUBLE AS w1, sum(b * p.w * n.w) / sum(pairs * p.w * n.w)::DOUBLE AS b, sum(l * p.w * n.w) / sum(pairs * p.w * n.w)::DOUBLE AS l FROM zu JOIN w p ON p.c = zu.s JOIN w n ON n.c = zu.t AND n.r = p.r GROUP BY 1, 2, 3),
    zp AS (SELECT split, lang, sum(w1) / sum(pairs) AS w1, sum(b) / sum(pairs) AS b, sum(l) / sum(pairs) AS l FROM zu GROUP BY 1, 2)"""
#: Rounded before it is printed, by the same rule in every engine, and never to a negative zero.
NEAR = "round(round({0}, 9), 3) + 0.0"
PRINTED = f"printf('%+.3f [%+.3f, %+.3f]', {NEAR.format('avg({0})')}, {NEAR.format('quantile_cont({0}, 0.025)')}, {NEAR.format('quantile_cont({0}, 0.975)')}) || CASE WHEN quantile_cont({{0}}, 0.025) > 0 OR quantile_cont({{0}}, 0.975) < 0 THEN '*' ELSE '' END"
SHARE = "CASE WHEN abs(l - w1) > 1e-3 THEN printf('%.0f%%', round(round(100 * (b - w1) / (l - w1), 7), 0) + 0.0) ELSE '-' END"


def near(c: Column) -> Column:
    return F.round(F.round(c, 9), 3) + F.lit(0.0)


def readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Longer rows with their split and three readings, and per split, language and replicate the AUC of each reading."""
    rows = scored(spark, sf_dir, 0, 1, 2)
    weights = bootstrap.draw_weights(spark, rows.select(F.col("source").alias("cluster")).distinct(), REPLICATES)
    own = written(rows.where("n_chars > 1000").select("source", "lang", "y", F.when(F.expr(DEV), "dev").otherwise("test").alias("split"), F.col("s0").alias("w1"), F.col("s1").alias("b"), F.col("s2").alias("l")))
    each = bootstrap.replicate_aucs(own.unpivot(["split", "lang", "source", "y"], ["w1", "b", "l"], "f", "s"), ["split", "lang", "f"], "source", "s", "y", weights, REPLICATES)
    value = lambda f: F.max(F.when(F.col("f") == f, F.col("auc"))).alias(f)
    return own, written(each.groupBy("split", "lang", F.col("b").alias("r")).agg(value("w1"), value("b"), value("l")))


def printed(limits: DataFrame, name: str) -> DataFrame:
    """Mean and interval as they are printed, a star where zero is outside."""
    text = F.concat(F.format_string("%+.3f [%+.3f, %+.3f]", *[near(F.col(c)) for c in ("mean", "lo", "hi")]), F.when(F.col("significant"), "*").otherwise(""))
    return limits.select(*[c for c in limits.columns if c not in ("mean", "lo", "hi", "p_le0", "n", "significant")], text.alias(name))


def share_text(w: str, b: str, full: str) -> Column:
    lost = F.col(full) - F.col(w)
    return F.when(F.abs(lost) > 1e-3, F.format_string("%.0f%%", F.round(F.round(100 * (F.col(b) - F.col(w)) / lost, 7), 0) + F.lit(0.0))).otherwise("-")


@query(f"""WITH {READINGS}, n AS (SELECT split, lang, count(*) || ' / ' || count(DISTINCT source) AS size FROM z GROUP BY 1, 2), c AS (SELECT split, lang, {PRINTED.format('(b - l)')} AS b_l, {PRINTED.format('(l - w1)')} AS l_w, {PRINTED.format('(b - w1)')} AS b_w FROM zd GROUP BY 1, 2)
    SELECT split, lang, size, {SHORT.format(NEAR.format('w1'))} || ' / ' || {SHORT.format(NEAR.format('b'))} || ' / ' || {SHORT.format(NEAR.format('l'))} AS aucs, b_l, l_w, b_w, {SHARE} AS recovered FROM zp JOIN n USING (split, lang) JOIN c USING (split, lang)""")
def appendix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows per run of the appendix tables as they are printed: sizes, three readings, the intervals of their differences, and the share of the loss that is recovered; all runs and splits in one bootstrap."""
    own, each = readings(spark, sf_dir)
    sizes = own.groupBy("split", "lang").agg(F.concat_ws(" / ", F.count(F.lit(1)).cast("string"), F.countDistinct("source").cast("string")).alias("size"))
    point = auc(own.unpivot(["split", "lang", "y"], ["w1", "b", "l"], "f", "s"), ["split", "lang", "f"], "s", "y").groupBy("split", "lang").pivot("f", ["w1", "b", "l"]).agg(F.first("auc"))
    out = sizes.join(point, ["split", "lang"])
    for a, b, name in (("b", "l", "b_l"), ("l", "w1", "l_w"), ("b", "w1", "b_w")):
        out = out.join(printed(bootstrap.interval(each.withColumn("diff", F.col(a) - F.col(b)), "split", "lang"), name), ["split", "lang"])
    text = lambda c: F.regexp_replace(F.format_string("%.3f", near(F.col(c))), r"^(-?)0\.", "$1.")
    return out.select("split", "lang", "size", F.concat_ws(" / ", text("w1"), text("b"), text("l")).alias("aucs"), "b_l", "l_w", "b_w", share_text("w1", "b", "l").alias("recovered"))


@query(f"""WITH {READINGS}, g AS (SELECT split, r, avg(b - l) AS b_l, avg(l - w1) AS l_w, avg(b - w1) AS b_w FROM zd GROUP BY 1, 2), p AS (SELECT split, avg(w1) AS w1, avg(b) AS b, avg(l) AS l FROM zp GROUP BY split),
    v AS (SELECT 'b - l' AS name, split, {PRINTED.format('b_l')} AS v FROM g GROUP BY split UNION ALL SELECT 'l - window 1', split, {PRINTED.format('l_w')} FROM g GROUP BY split UNION ALL SELECT 'b - window 1', split, {PRINTED.format('b_w')} FROM g GROUP BY split UNION ALL SELECT 'recovered', split, {SHARE} FROM p)
    SELECT name, max(v) FILTER (WHERE split = 'dev') AS dev, max(v) FILTER (WHERE split = 'test') AS test FROM v GROUP BY name""")
def appendix_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled rows of the appendix tables, development beside test: differences averaged over runs in each replicate, and the share recovered by the averages."""
    own, each = readings(spark, sf_dir)
    pairs = (("b - l", "b", "l"), ("l - window 1", "l", "w1"), ("b - window 1", "b", "w1"))
    long_ = each.select("split", "r", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (F.col(a) - F.col(b)).alias("diff")) for n, a, b in pairs])).alias("d"))
    pooled = long_.groupBy("d.name", "split", "r").agg(F.avg("d.diff").alias("diff"))
    told = printed(bootstrap.interval(pooled, "name", "split"), "v")
    point = auc(own.unpivot(["split", "lang", "y"], ["w1", "b", "l"], "f", "s"), ["split", "lang", "f"], "s", "y").groupBy("split").pivot("f", ["w1", "b", "l"]).agg(F.avg("auc"))
    told = told.unionByName(point.select(F.lit("recovered").alias("name"), "split", share_text("w1", "b", "l").alias("v")))
    return told.groupBy("name").pivot("split", ["dev", "test"]).agg(F.first("v"))


@query(r"""WITH c AS (SELECT source, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS n FROM documents), l AS (SELECT source, n, least(n, 512) AS own, 8192 - 48 - least(n, 512) AS room FROM c), s AS (SELECT source, n > room AS cut, least(n, greatest(0, room)) + 40 + own AS len FROM l)
    SELECT source, sum(cut::INT) || ' / ' || count(*) AS cut, round(median(len)) || ' / ' || max(len) AS seq_len FROM s GROUP BY source""")
def appendix_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one long pass costs per run, as it is printed: contexts cut of all, and the median and largest length of what is read."""
    from plumbline.operators.tokens import tokens

    n = F.col("n")
    own = F.least(n, F.lit(512))
    room = F.lit(8192 - 48) - own
    rows = table(spark, sf_dir, "documents").select("source", F.size(tokens(F.col("text"))).cast("long").alias("n"))
    rows = written(rows.select("source", (n > room).alias("cut"), (F.least(n, F.greatest(F.lit(0), room)) + 40 + own).cast("double").alias("len")))
    about = rows.groupBy("source").agg(F.concat_ws(" / ", F.count_if("cut").cast("string"), F.count(F.lit(1)).cast("string")).alias("cut"), F.max("len").cast("long").alias("most"))
    told = with_order_statistics(about, rows, ["source"], "len", [0.5], ["middle"])
    return told.select("source", "cut", F.concat_ws(" / ", F.format_string("%.1f", F.round("middle")), F.col("most").cast("string")).alias("seq_len"))
