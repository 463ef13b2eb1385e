"""Attention and hidden-state features over supplied arrays. The 64 components of an embedding stand for 8 layers of 8 heads, or for attention weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import arrays
from plumbline.functions.scalar import rounded
from plumbline.plans.assembly import BASE, base
from plumbline.plans.registry import query, table

LONG = "u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS w, generate_subscripts(embedding, 1) AS p FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", arrays.doubles(F.col("embedding")).alias("x"))


@query(f"""WITH {LONG}, c AS (SELECT vec_id, avg(abs(w)) AS ctx FROM u WHERE p <= 40 GROUP BY 1), n AS (SELECT vec_id, p, avg(abs(w)) OVER (PARTITION BY vec_id ORDER BY p) AS new FROM u WHERE p > 40)
    SELECT vec_id, round(avg(ctx / (ctx + new)), 6) + 0.0 AS ratio, round(min(ctx / (ctx + new)), 6) + 0.0 AS low FROM c JOIN n USING (vec_id) GROUP BY 1""")
def lookback_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention on 40 context places against the answer so far, averaged over the answer's tokens."""
    r = vectors(spark, sf_dir).select("vec_id", arrays.lookback(F.transform("x", lambda w: F.abs(w)), 40).alias("r"))
    return r.select("vec_id", rounded(arrays.mean(F.col("r"))).alias("ratio"), rounded(F.array_min("r")).alias("low"))


@query(f"""WITH {LONG} SELECT vec_id, string_agg((p - 1)::VARCHAR, ',' ORDER BY r) AS places FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, p) AS r FROM u) WHERE r <= 7 GROUP BY 1""")
def topk_attended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.array_join(arrays.top_positions(F.col("x"), 0.1).cast("array<string>"), ",").alias("places"))


@query(f"""WITH {LONG}, t AS (SELECT a.vec_id, sum(a.w * b.w) AS ab, sum(a.w * a.w) AS aa, sum(b.w * b.w) AS bb FROM u a JOIN u b ON a.vec_id = b.vec_id AND b.p = a.p + 32 GROUP BY 1)
    SELECT vec_id, round(ab / (greatest(sqrt(aa), 1e-8) * greatest(sqrt(bb), 1e-8)), 6) + 0.0 AS ecs FROM t""")
def ecs_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External context score: cosine of the answer's state with the attended context's."""
    return vectors(spark, sf_dir).select("vec_id", rounded(arrays.cosine(F.slice("x", 1, 32), F.slice("x", 33, 32))).alias("ecs"))


@query(f"""WITH {LONG}, s AS (SELECT vec_id, p % 32 AS q, p > 32 AS side, w - ln(sum(exp(w)) OVER (PARTITION BY vec_id, p > 32)) AS lp FROM u),
    m AS (SELECT a.vec_id, a.lp AS p, b.lp AS q, ln(0.5 * exp(a.lp) + 0.5 * exp(b.lp)) AS m FROM s a JOIN s b ON a.vec_id = b.vec_id AND a.q = b.q AND NOT a.side AND b.side)
    SELECT vec_id, round(0.5 * sum(exp(p) * (p - m)) + 0.5 * sum(exp(q) * (q - m)), 6) + 0.0 AS pks FROM m GROUP BY 1""")
def pks_jsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parametric knowledge score: Jensen-Shannon divergence of the states before and after a layer."""
    logs = vectors(spark, sf_dir).select("vec_id", arrays.log_softmax(F.slice("x", 1, 32)).alias("p"), arrays.log_softmax(F.slice("x", 33, 32)).alias("q"))
    return logs.select("vec_id", rounded(arrays.jensen_shannon(F.col("p"), F.col("q"))).alias("pks"))


@query(f"""WITH {LONG} SELECT vec_id, round(-coalesce(sum(w) FILTER (WHERE w < 0), 0), 6) + 0.0 AS drops, round(min(w), 6) + 0.0 AS worst FROM u WHERE p <= 8 AND w < 0.5 GROUP BY 1""")
def signed_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minus the sum of negative changes, and the worst change, of a JSON list that may hold nulls."""
    text = F.to_json(F.transform(F.slice("x", 1, 8), lambda v: F.when(v < 0.5, v)), {"ignoreNullFields": "false"})
    parsed = vectors(spark, sf_dir).select("vec_id", F.filter(F.from_json(text, "array<double>"), lambda v: v.isNotNull()).alias("d")).where(F.size("d") > 0)
    return parsed.select("vec_id", rounded(-arrays.total(F.filter("d", lambda v: v < 0))).alias("drops"), rounded(F.array_min("d")).alias("worst"))


@query("""SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_extract(props, '$.k')::BIGINT % 10 > 4 AS high FROM events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), (k % 10 > 4).alias("high"))


@query(f"""WITH {LONG} SELECT vec_id, ((p - 1) // 8)::BIGINT AS layer, round(avg(w), 6) + 0.0 AS mean, round(((p - 1) // 8) / 7.0, 6) + 0.0 AS depth, CASE WHEN (p - 1) // 8 < 3 THEN 0 WHEN (p - 1) // 8 < 6 THEN 1 ELSE 2 END::BIGINT AS third FROM u GROUP BY 1, 2, 4, 5""")
def layer_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over heads per layer, relative depth, and thirds of the layers (the first n mod 3 thirds take one more)."""
    layers = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(i.cast("long").alias("layer"), arrays.mean(F.slice("x", i * 8 + 1, F.lit(8))).alias("m")))
    each = vectors(spark, sf_dir).select("vec_id", F.inline(layers))
    third = F.when(F.col("layer") < 3, 0).when(F.col("layer") < 6, 1).otherwise(2).cast("long")
    return each.select("vec_id", "layer", rounded(F.col("m")).alias("mean"), rounded(F.col("layer") / F.lit(7.0)).alias("depth"), third.alias("third"))


CORR = f"""{BASE}, f AS (SELECT label, unnest(x)::DOUBLE AS w, generate_subscripts(x, 1) - 1 AS p FROM base),
    r AS (SELECT p, covar_pop(w, label) / (stddev_pop(w) * stddev_pop(label) + 1e-12) AS r FROM f GROUP BY p)"""


def feature_correlations(df: DataFrame) -> DataFrame:
    """(p, r): correlation of each array component with the label; a constant component has 0. One long-form aggregate, no column per feature."""
    long_ = df.select("label", F.posexplode("x").alias("p", "w")).withColumns({"w": F.col("w").cast("double"), "label": F.col("label").cast("double")})
    return long_.groupBy("p").agg((F.covar_pop("w", "label") / (F.stddev_pop("w") * F.stddev_pop("label") + F.lit(1e-12))).alias("r"))


@query(f"WITH {CORR} SELECT p::BIGINT AS p, round(r, 6) + 0.0 AS r, row_number() OVER (ORDER BY round(r, 9), p) AS rising, row_number() OVER (ORDER BY round(abs(r), 9) DESC, p) AS by_size FROM r")
def feature_label_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = feature_correlations(base(spark, sf_dir))
    rank = lambda *o: F.row_number().over(Window.orderBy(*o)).cast("long")  # noqa: E731  one row per feature
    return r.select(F.col("p").cast("long").alias("p"), rounded(F.col("r")).alias("r"), rank(F.round("r", 9), "p").alias("rising"), rank(F.desc(F.round(F.abs("r"), 9)), "p").alias("by_size"))


NS, KS = (1, 2, 4, 8), (1, 2, 4)
GRID = [(n, m, b) for n in NS for m in KS for b in (0.0, 0.5, 1.0, 2.0)]


@query(f"""WITH {CORR}, e AS (SELECT p, row_number() OVER (ORDER BY round(r, 9), p) AS k FROM r WHERE p < 32), q AS (SELECT p, row_number() OVER (ORDER BY round(r, 9) DESC, p) AS k FROM r WHERE p >= 32),
    l AS (SELECT doc_id, label, unnest(x)::DOUBLE AS w, generate_subscripts(x, 1) - 1 AS p FROM base),
    es AS (SELECT doc_id, k, sum(w) OVER (PARTITION BY doc_id ORDER BY k) AS s FROM l JOIN e USING (p)), ps AS (SELECT doc_id, label, k, sum(w) OVER (PARTITION BY doc_id ORDER BY k) AS s FROM l JOIN q USING (p)),
    g AS (SELECT unnest([{", ".join(f"{{'n': {n}, 'm': {m}, 'b': {b}::DOUBLE}}" for n, m, b in GRID)}], recursive := true)),
    t AS (SELECT n, m, b, label, round(ps.s - b * es.s, 6) AS v FROM g JOIN es ON es.k = n JOIN ps ON ps.k = m AND ps.doc_id = es.doc_id),
    a AS (SELECT n, m, b, (sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0))::DOUBLE AS auc
    FROM (SELECT *, rank() OVER (PARTITION BY n, m, b ORDER BY v) + (count(*) OVER (PARTITION BY n, m, b, v) - 1) / 2.0 AS rk FROM t) GROUP BY 1, 2, 3)
    SELECT n::BIGINT AS n, m::BIGINT AS m, b, round(auc, 6) + 0.0 AS auc, row_number() OVER (ORDER BY round(auc, 9) DESC, n, m, b) = 1 AS best FROM a""")
def redeep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear score, knowledge minus beta times context, over a grid: every grid point adds the first of the ranked components of a row's own array."""
    from plumbline.operators.metrics import auc

    df = base(spark, sf_dir)
    r = feature_correlations(df).select("p", F.round("r", 9).alias("r"))
    # one row: the components of each part in the order of their correlation
    places = lambda x: F.transform(x, lambda s: s["p"])
    order = r.agg(places(F.sort_array(F.collect_list(F.when(F.col("p") < 32, F.struct("r", "p"))))).alias("e"), places(F.sort_array(F.collect_list(F.when(F.col("p") >= 32, F.struct((-F.col("r")).alias("r"), "p"))))).alias("k"))
    x = arrays.doubles(F.col("x"))
    first = lambda o, n: arrays.total(F.transform(F.slice(o, 1, n), lambda p: F.get(x, p)))
    value = lambda n, m, b: F.struct(F.lit(n).cast("long").alias("n"), F.lit(m).cast("long").alias("m"), F.lit(b).alias("b"), F.round(F.get("q", F.lit(KS.index(m))) - b * F.get("s", F.lit(NS.index(n))), 6).alias("v"))
    sums = df.join(F.broadcast(order)).select("label", F.array(*[first("e", n) for n in NS]).alias("s"), F.array(*[first("k", m) for m in KS]).alias("q"))
    scored = sums.select("label", F.inline(F.array(*[value(*g) for g in GRID])))
    found = auc(scored, ["n", "m", "b"], "v", "label")
    best = F.row_number().over(Window.orderBy(F.desc(F.round("auc", 9)), "n", "m", "b")) == 1
    return found.select("n", "m", "b", rounded(F.col("auc")).alias("auc"), best.alias("best"))


@query(f"""WITH {LONG} SELECT a.vec_id, round(max(abs(a.w - b.w)), 6) + 0.0 AS top_gap, round(avg(abs(a.w - b.w)), 6) + 0.0 AS mean_gap, sum((abs(a.w - b.w) > 1)::INT)::BIGINT AS beyond
    FROM u a JOIN u b ON b.vec_id = a.vec_id AND b.p = 65 - a.p GROUP BY 1""")
def block_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest and mean absolute difference of two aligned blocks, and how many components are beyond a tolerance."""
    gaps = F.zip_with("x", F.reverse("x"), lambda a, b: F.abs(a - b))
    g = vectors(spark, sf_dir).select("vec_id", gaps.alias("g"))
    return g.select("vec_id", rounded(F.array_max("g")).alias("top_gap"), rounded(arrays.mean(F.col("g"))).alias("mean_gap"), F.size(F.filter("g", lambda v: v > 1)).cast("long").alias("beyond"))


@query(f"""WITH {LONG} SELECT vec_id, p::BIGINT AS p, round(greatest(a, coalesce(b, a)), 6) + 0.0 AS w FROM (SELECT u.vec_id, u.p, u.w AS a, v.w AS b FROM u LEFT JOIN u v ON v.vec_id = u.vec_id AND u.p <= 10 AND v.p = u.p + 40 WHERE u.p <= 16)""")
def joined_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-wise maximum over the common prefix of two blocks; the longer block's rest stays."""
    both = vectors(spark, sf_dir).select("vec_id", F.posexplode(arrays.joined_max(F.slice("x", 1, 16), F.slice("x", 41, 10))).alias("p", "w"))
    return both.select("vec_id", (F.col("p") + 1).cast("long").alias("p"), rounded(F.col("w")).alias("w"))


@query(f"""WITH {LONG}, d AS (SELECT a.vec_id, k, sum(a.w * cos(2 * pi() * k * (a.p - 1) / 64)) AS re, sum(a.w * sin(2 * pi() * k * (a.p - 1) / 64)) AS im FROM u a, (SELECT unnest(range(64)) AS k) WHERE least(k, 64 - k) / 64.0 >= 0.45 GROUP BY 1, 2)
    SELECT vec_id, round(sqrt(sum(re * re + im * im) / 64), 6) + 0.0 AS norm FROM d GROUP BY 1""")
def high_pass_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 norm of the part of a signal above a cut-off frequency: an FFT over Arrow batches, by Parseval's identity."""
    from plumbline.operators.signal import high_pass

    return vectors(spark, sf_dir).select("vec_id", rounded(high_pass(F.col("x"))).alias("norm"))


@query(f"""WITH {LONG}, q AS (SELECT vec_id, (p - 1) // 8 AS i, (p - 1) % 8 AS d, w FROM u WHERE p > 40), k AS (SELECT vec_id, (p - 1) // 8 AS j, (p - 1) % 8 AS d, w FROM u),
    z AS (SELECT q.vec_id, i, j, sum(q.w * k.w) / sqrt(8) AS z FROM q JOIN k ON q.vec_id = k.vec_id AND q.d = k.d WHERE j <= i GROUP BY 1, 2, 3)
    SELECT vec_id, (i - 5)::BIGINT AS i, j::BIGINT AS j, round(exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id, i), 6) + 0.0 AS w FROM z""")
def answer_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention rows of the last three of eight tokens, recomputed from queries and keys with a causal mask."""
    from plumbline.operators.signal import causal_rows

    rows = vectors(spark, sf_dir).select("vec_id", F.posexplode(causal_rows(8)(F.slice("x", 41, 24), F.col("x"))).alias("p", "w"))
    each = rows.select("vec_id", F.floor(F.col("p") / 8).alias("i"), (F.col("p") % 8).cast("long").alias("j"), rounded(F.col("w")).alias("w"))
    return each.where("j <= i + 5")


ROWS = f"{LONG}, a AS (SELECT vec_id, (p - 1) // 16 AS i, (p - 1) % 16 AS j, abs(w) AS w FROM u)"


@query(f"""WITH {ROWS}, c AS (SELECT vec_id, i, avg(w) AS c FROM a WHERE j < 12 GROUP BY 1, 2), n AS (SELECT vec_id, i, sum(w) FILTER (WHERE j <= 12 + i) / (i + 1) AS n FROM a WHERE j >= 12 GROUP BY 1, 2)
    SELECT vec_id, i::BIGINT AS i, round(c / (c + n), 6) + 0.0 AS ratio FROM c JOIN n USING (vec_id, i)""")
def lookback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer token has a row of weights of its own: the mean on 12 context places against that on the answer tokens up to it."""
    return token_ratios(vectors(spark, sf_dir)).select("vec_id", "i", rounded(F.col("ratio")).alias("ratio"))


def token_ratios(x: DataFrame, n: int = 4, context: int = 12) -> DataFrame:
    """(vec_id, i, ratio) of rows of weights of ``n`` answer tokens, one after the other in ``x``."""
    size = F.size("x") / n
    rows = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.cast("long").alias("i"), arrays.lookback_of(F.transform(F.slice("x", (i * size).cast("int") + 1, size.cast("int")), lambda w: F.abs(w)), context, i).alias("ratio")))
    return x.select("vec_id", F.inline(rows))


@query(f"""WITH {ROWS}, c AS (SELECT vec_id, i, avg(w) AS c FROM a WHERE j < 12 GROUP BY 1, 2), n AS (SELECT vec_id, i, sum(w) FILTER (WHERE j <= 12 + i) / (i + 1) AS n FROM a WHERE j >= 12 GROUP BY 1, 2)
    SELECT vec_id // 40 AS case_id, i // 2 AS sent, vec_id % 4 AS head, round(avg(c / (c + n)), 6) + 0.0 AS ratio, count(*) AS n_tok FROM c JOIN n USING (vec_id, i) GROUP BY 1, 2, 3""")
def lookback_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ratios averaged per case, sentence and head."""
    each = token_ratios(vectors(spark, sf_dir)).select(F.floor(F.col("vec_id") / 40).alias("case_id"), F.floor(F.col("i") / 2).alias("sent"), (F.col("vec_id") % 4).alias("head"), "ratio")
    return each.groupBy("case_id", "sent", "head").agg(rounded(F.avg("ratio")).alias("ratio"), F.count(F.lit(1)).alias("n_tok"))


@query(f"""WITH {LONG}, l AS (SELECT vec_id, p, w - ln(sum(exp(w)) OVER (PARTITION BY vec_id)) AS lp FROM u), e AS (SELECT vec_id, label FROM embeddings)
    SELECT label::BIGINT AS sent, round(avg(lp), 6) + 0.0 AS logprob, count(*) AS n_tok FROM l JOIN e USING (vec_id) WHERE p - 1 = vec_id * 7 % 64 GROUP BY label""")
def sentence_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-probability of each token's target among all, averaged over the sentence's tokens."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("sent"), arrays.doubles(F.col("embedding")).alias("x"))
    target = F.get("x", (F.col("vec_id") * 7 % 64).cast("int")) - arrays.log_sum_exp(F.col("x"))
    return own.select("sent", target.alias("lp")).groupBy("sent").agg(rounded(F.avg("lp")).alias("logprob"), F.count(F.lit(1)).alias("n_tok"))


@query(f"""WITH {LONG}, t AS (SELECT vec_id, p AS tok FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, p) AS r FROM u WHERE p <= 7) WHERE r <= ceil(0.3 * 7)),
    h AS (SELECT vec_id, (p - 1) // 8 + 1 AS tok, (p - 1) % 8 AS d, w FROM u), m AS (SELECT vec_id, d, avg(w) AS m FROM h JOIN t USING (vec_id, tok) GROUP BY 1, 2), a AS (SELECT vec_id, d, w FROM h WHERE tok = 8)
    SELECT vec_id, round(sum(m * w) / (greatest(sqrt(sum(m * m)), 1e-8) * greatest(sqrt(sum(w * w)), 1e-8)), 6) + 0.0 AS ecs FROM m JOIN a USING (vec_id, d) GROUP BY vec_id""")
def ecs_attended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the answer's state with the mean state of the most attended context tokens: 7 of 8 tokens with states of 8 numbers, the share of 0.3 with the largest weights."""
    state = lambda i: F.slice("x", i * 8 + 1, F.lit(8))
    top = vectors(spark, sf_dir).withColumn("top", arrays.top_positions(F.slice("x", 1, 7), 0.3))
    chosen = F.transform("top", state)
    mean = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda d: arrays.mean(F.transform(chosen, lambda h: F.get(h, d))))
    return top.select("vec_id", "x", mean.alias("m")).select("vec_id", rounded(arrays.cosine(F.col("m"), F.slice("x", 57, 8))).alias("ecs"))


@query(f"""WITH {LONG} SELECT u.vec_id, q::BIGINT AS p, round(CASE WHEN q <= 32 THEN u.w ELSE greatest(u.w, v.w) END, 6) + 0.0 AS w FROM (SELECT unnest(range(1, 65)) AS q) JOIN u ON u.p = CASE WHEN q <= 32 THEN q ELSE q - 32 END JOIN u v ON v.vec_id = u.vec_id AND v.p = u.p + 32""")
def window1_and_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block of window 1's features and, behind them, their maxima over the windows."""
    first, second = F.slice("x", 1, 32), F.slice("x", 33, 32)
    both = vectors(spark, sf_dir).select("vec_id", F.posexplode(F.concat(first, arrays.joined_max(first, second))).alias("p", "w"))
    return both.select("vec_id", (F.col("p") + 1).cast("long").alias("p"), rounded(F.col("w")).alias("w"))


@query(f"""WITH {LONG}, d AS (SELECT a.vec_id, s, k, sum(a.w * cos(2 * pi() * k * (a.p - 1) / 32)) AS re, sum(a.w * sin(2 * pi() * k * (a.p - 1) / 32)) AS im FROM (SELECT vec_id, (p - 1) // 32 AS s, (p - 1) % 32 + 1 AS p, w FROM u) a, (SELECT unnest(range(32)) AS k) WHERE least(k, 32 - k) / 32.0 >= 0.45 GROUP BY 1, 2, 3),
    n AS (SELECT vec_id, s, sqrt(sum(re * re + im * im) / 32) AS n FROM d GROUP BY 1, 2) SELECT vec_id, round(max(n) FILTER (WHERE s = 0), 6) + 0.0 AS context, round(max(n) FILTER (WHERE s = 1), 6) + 0.0 AS answer FROM n GROUP BY 1""")
def frequency_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-frequency norms of the context's and of the answer's part of the weights."""
    from plumbline.operators.signal import high_pass

    return vectors(spark, sf_dir).select("vec_id", rounded(high_pass(F.slice("x", 1, 32))).alias("context"), rounded(high_pass(F.slice("x", 33, 32))).alias("answer"))


@query(f"""WITH {BASE}, s AS (SELECT doc_id, f, list_transform(x, lambda w: w::DOUBLE)[(f - 1) * 21 + 1 : CASE WHEN f = 3 THEN 64 ELSE f * 21 END] AS part FROM base, (SELECT unnest([1, 2, 3]) AS f))
    SELECT doc_id, f::BIGINT AS part, len(part)::BIGINT AS n, round(list_avg(part), 6) + 0.0 AS mean, round(list_avg(list_sort(part, 'DESC')[1:5]), 6) + 0.0 AS top5 FROM s""")
def head_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subsets of the heads: thirds of the block, and the five largest of each."""
    x = arrays.doubles(F.col("x"))
    parts = F.explode(F.array(*[F.struct(F.lit(i + 1).cast("long").alias("part"), F.slice(x, i * 21 + 1, 22 if i == 2 else 21).alias("v")) for i in range(3)])).alias("s")
    each = base(spark, sf_dir).select("doc_id", parts).select("doc_id", "s.part", "s.v")
    return each.select("doc_id", "part", F.size("v").cast("long").alias("n"), rounded(arrays.mean(F.col("v"))).alias("mean"), rounded(arrays.mean(F.slice(F.sort_array("v", asc=False), 1, 5))).alias("top5"))
