"""Samples, folds, splits and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import sampling
from plumbline.operators.ranks import placed
from plumbline.plans.registry import query, table


@query("""WITH l AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('7:' || doc_id), doc_id) AS r FROM labels), n AS (SELECT least(min(c), 40) AS n FROM (SELECT count(*) AS c FROM labels GROUP BY toxic))
    SELECT doc_id, toxic::BIGINT AS toxic FROM l, n WHERE r <= n""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("long").alias("toxic"))
    return sampling.balanced_sample(rows, "toxic", "doc_id", 40, 7)


@query("""SELECT source, (row_number() OVER (ORDER BY md5('3:' || source), source) - 1) % 5 AS fold FROM (SELECT DISTINCT source FROM documents)""")
def random_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_folds(table(spark, sf_dir, "documents"), "source", 5, 3)


@query("""WITH RECURSIVE g AS (SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS i FROM (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1)),
    f AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0]::BIGINT[] AS w, NULL::VARCHAR AS source, NULL::BIGINT AS fold UNION ALL
    SELECT g.i, [CASE WHEN j = list_position(w, list_min(w)) THEN w[j] + n ELSE w[j] END FOR j IN [1, 2, 3, 4]], g.source, list_position(w, list_min(w)) - 1 FROM f JOIN g ON g.i = f.i + 1)
    SELECT source, fold FROM f WHERE source IS NOT NULL""")
def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups to folds by falling size, without a driver that holds them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    sizes = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sampling.greedy_folds(sizes, "source", "n", 4)


@query("""SELECT d.doc_id, s.half FROM documents d JOIN (SELECT source, CASE WHEN row_number() OVER (ORDER BY md5('0:' || source), source) <= count(*) OVER () // 2 THEN 'A' ELSE 'B' END AS half FROM (SELECT DISTINCT source FROM documents)) s USING (source)""")
def half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in a seeded order, the first half is A."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    groups = docs.select("source").distinct().withColumn("h", sampling.hash_order(0, F.col("source")))
    halves = placed(groups, [], ["h", "source"]).select("source", F.when(F.col("at") < F.floor(F.col("size") / 2), "A").otherwise("B").alias("half"))
    return docs.join(halves, "source").select("doc_id", "half")


@query("""SELECT user_id, (row_number() OVER (ORDER BY user_id::VARCHAR) - 1) % 3 AS shard FROM (SELECT DISTINCT user_id FROM events)""")
def strided_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in lexical order, dealt round to shards: places come from a range partition, without one task that holds all."""
    ids = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("k"), "user_id").distinct()
    return placed(ids, [], ["k"]).select("user_id", (F.col("at") % 3).alias("shard"))


@query("""SELECT cut, count(*) AS n_kept FROM (SELECT 1000 * (max(n_chars) // 1000 + 1) AS cut FROM (SELECT n_chars, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS n FROM documents) WHERE n <= 600), documents WHERE n_chars >= cut GROUP BY cut""")
def smallest_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest thousand of characters from which every text exceeds a window: a closed form, no search."""
    from plumbline.operators.tokens import tokens

    docs = table(spark, sf_dir, "documents").select("n_chars", F.size(tokens(F.col("text"))).alias("n"))
    cut = docs.where("n <= 600").agg((1000 * (F.floor(F.max("n_chars") / 1000) + 1)).alias("cut"))
    return docs.join(F.broadcast(cut), F.col("n_chars") >= F.col("cut")).groupBy("cut").agg(F.count(F.lit(1)).alias("n_kept"))  # one row
