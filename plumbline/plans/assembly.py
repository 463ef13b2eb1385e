"""Relational assembly: joining blocks onto the sentence table, roll-ups, checks of keys and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import rounded, text_id
from plumbline.operators.matching import containing
from plumbline.plans.registry import query, table

#: The evaluation base as SQL: documents with labels and their feature block.
BASE = "base AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, l.toxic AS label, l.quality, e.embedding AS x FROM documents d JOIN labels l USING (doc_id) JOIN embeddings e ON e.vec_id = d.doc_id)"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels and features: one row per labelled document, features as one array column."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"), "quality")
    block = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("x"))
    return docs.join(labels, "doc_id").join(block, "doc_id")


@query("""SELECT c.conv_id, c.turn, d.source, l.toxic::BIGINT AS label, (c.turn / (max(c.turn) OVER (PARTITION BY c.conv_id) + 1.0)) AS rel_pos,
    coalesce(d.n_chars > 2000, false) AS truncated FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id LEFT JOIN labels l ON l.doc_id = c.conv_id""")
def sentence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence table with 1:1 dimensions joined on, relative position by window, and a keyed flag."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), F.col("toxic").cast("long").alias("label"))
    joined = turns.join(docs, "conv_id", "left").join(labels, "conv_id", "left")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    return joined.select("conv_id", "turn", "source", "label", (F.col("turn") / (last + F.lit(1.0))).alias("rel_pos"), F.coalesce(F.col("n_chars") > 2000, F.lit(False)).alias("truncated"))


@query(f"""WITH {BASE} SELECT source, count(*) AS n, max(x[1]::DOUBLE) AS top, min(x[2]::DOUBLE) AS low, round(avg(x[3]::DOUBLE), 6) + 0.0 AS mean_pos,
    min(lang) AS task, max(label)::BIGINT AS label, count(DISTINCT lang) AS n_tasks, sum((n_chars > 2000)::INT)::BIGINT AS n_long FROM base GROUP BY source""")
def response_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.col("x")[i].cast("double")
    return base(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.max(at(0)).alias("top"), F.min(at(1)).alias("low"), rounded(F.avg(at(2))).alias("mean_pos"),
        F.min("lang").alias("task"), F.max("label").cast("long").alias("label"), F.countDistinct("lang").alias("n_tasks"), F.count_if(F.col("n_chars") > 2000).alias("n_long"),
    )


@query("""SELECT label::BIGINT AS label, pos::BIGINT AS pos, max(w::DOUBLE) AS top, round(avg(w::DOUBLE), 6) + 0.0 AS mean FROM
    (SELECT label, unnest(embedding) AS w, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos""")
def window_max_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-wise maximum and mean of feature arrays over the windows of a case."""
    each = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("p", "w"))
    w = F.col("w").cast("double")
    return each.groupBy("label", (F.col("p") + 1).cast("long").alias("pos")).agg(F.max(w).alias("top"), rounded(F.avg(w)).alias("mean"))


@query("""WITH d AS (SELECT doc_id FROM documents), l AS (SELECT doc_id, quality FROM labels) SELECT count(*) AS n_rows, count(l.doc_id) AS covered,
    count(*) - count(l.doc_id) AS missing, (SELECT count(*) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM d)) AS extra,
    (SELECT count(*) FROM (SELECT doc_id FROM l GROUP BY doc_id HAVING count(*) > 1)) AS repeated, sum((l.quality = 1)::INT)::BIGINT AS matching FROM d LEFT JOIN l USING (doc_id)""")
def alignment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of a block against the master table in one full outer join of keys with conditional counts."""
    master = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"))
    block = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("quality") == 1).alias("q"))
    both = master.join(block, "doc_id", "full")
    m, k = F.coalesce("m", F.lit(0)), F.coalesce("k", F.lit(0))
    rows = F.sum(m * F.greatest(k, F.lit(1)))
    return both.agg(rows.alias("n_rows"), F.sum(m * k).alias("covered"), (rows - F.sum(m * k)).alias("missing"), F.sum(F.when(F.col("m").isNull(), k).otherwise(0)).alias("extra"), F.count_if(k > 1).alias("repeated"), F.sum(m * F.coalesce("q", F.lit(0))).alias("matching"))


@query("""WITH s AS (SELECT doc_id, doc_id % 4 AS shard FROM documents WHERE doc_id % 97 <> 5), s2 AS (SELECT * FROM s UNION ALL SELECT doc_id, 9 FROM s WHERE doc_id % 50 = 7)
    SELECT d.doc_id, count(s2.doc_id) AS times, CASE WHEN count(s2.doc_id) = 0 THEN 'missing' ELSE 'repeated' END AS fault
    FROM documents d LEFT JOIN s2 USING (doc_id) GROUP BY d.doc_id HAVING count(s2.doc_id) <> 1""")
def shard_merge_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the union of shards does not hold exactly once."""
    master = table(spark, sf_dir, "documents").select("doc_id")
    parts = master.where("doc_id % 97 <> 5").withColumn("shard", F.col("doc_id") % 4)
    merged = parts.unionByName(parts.where("doc_id % 50 = 7").withColumn("shard", F.lit(9).cast("long")))
    times = master.join(merged, "doc_id", "left").groupBy("doc_id").agg(F.count("shard").alias("times"))
    return times.where("times <> 1").withColumn("fault", F.when(F.col("times") == 0, "missing").otherwise("repeated"))


@query("""WITH m AS (SELECT doc_id, source, doc_id % 3 = 0 AS dev FROM documents) SELECT source, count(*) FILTER (WHERE dev) AS n_dev, count(*) FILTER (WHERE NOT dev) AS n_test
    FROM m GROUP BY source HAVING count(*) FILTER (WHERE dev) > 0 AND count(*) FILTER (WHERE NOT dev) > 0""")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources on both sides of a split."""
    dev = F.col("doc_id") % 3 == 0
    sides = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(dev).alias("n_dev"), F.count_if(~dev).alias("n_test"))
    return sides.where("n_dev > 0 and n_test > 0")


@query("""SELECT id, n, CASE WHEN n = 1 THEN 'unique' ELSE 'shared' END AS kind FROM (SELECT substr(md5(text), 1, 12) AS id, count(*) AS n FROM documents GROUP BY 1)""")
def md5_source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").groupBy(text_id(F.col("text")).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return ids.withColumn("kind", F.when(F.col("n") == 1, "unique").otherwise("shared"))


@query("""SELECT a.source, count(*) AS n_texts, max(a.k) AS most FROM (SELECT source, text, count(DISTINCT doc_id) AS k FROM documents GROUP BY source, text) a GROUP BY a.source""")
def one_to_one_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key sets per group: how many ids share a text inside a source. Texts are compared by their hash."""
    ids = table(spark, sf_dir, "documents").groupBy("source", F.sha2("text", 256).alias("h")).agg(F.countDistinct("doc_id").alias("k"))
    return ids.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.max("k").alias("most"))


@query("""WITH a AS (SELECT DISTINCT source FROM documents WHERE doc_id % 2 = 0 AND lang = 'en'), b AS (SELECT DISTINCT source FROM documents WHERE doc_id % 2 = 1 AND lang = 'fr')
    SELECT 'both' AS side, source FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', source FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT 'either', source FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    a = docs.where("doc_id % 2 = 0 and lang = 'en'").select("source").distinct()
    b = docs.where("doc_id % 2 = 1 and lang = 'fr'").select("source").distinct()
    named = lambda side, df: df.select(F.lit(side).alias("side"), "source")
    return named("both", a.intersect(b)).union(named("first", a.subtract(b))).union(named("either", a.union(b).distinct()))


@query("""SELECT text AS text_key, doc_id FROM (SELECT md5(text) AS text, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-preserving deduplication: the first row of each key, as an aggregate without ordering."""
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("text_key")).agg(F.min("doc_id").alias("doc_id"))


@query("""SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AND d.source NOT IN (SELECT source FROM documents WHERE doc_id < 10)""")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    seen = docs.where("doc_id < 10").select("source").distinct()
    return docs.join(bad, "doc_id", "left_semi").join(seen, "source", "left_anti").select("doc_id", "lang")


@query("""SELECT d.doc_id, coalesce(l.toxic, -1)::BIGINT AS flag, (l.doc_id IS NOT NULL) AS matched FROM documents d LEFT JOIN labels l USING (doc_id)""")
def default_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe with a default, and a marker column of what matched."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(True).alias("m"))
    both = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return both.select("doc_id", F.coalesce("toxic", F.lit(-1)).cast("long").alias("flag"), F.coalesce("m", F.lit(False)).alias("matched"))


@query("""SELECT doc_id, id AS benchmark_id, place FROM (SELECT d.doc_id, b.item_id AS id, position(b.text IN d.text)::BIGINT AS place, row_number() OVER (PARTITION BY d.doc_id ORDER BY (left(b.text, 200) = left(d.text, 200)) DESC, b.item_id) AS r
    FROM documents d JOIN benchmark b ON contains(d.text, b.text)) WHERE r = 1""")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate per row: those with the same prefix first, then file order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    found = containing(docs, table(spark, sf_dir, "benchmark"))
    first = Window.partitionBy("doc_id").orderBy(F.desc(F.left("text", F.lit(200)) == F.left("t", F.lit(200))), "item_id")
    return found.withColumn("r", F.row_number().over(first)).where("r = 1").select("doc_id", F.col("item_id").alias("benchmark_id"), "place")
