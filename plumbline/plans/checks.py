"""Checks of rows, orders, keys and files, and the small relational pieces they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import rounded, text_id
from plumbline.operators.joins import closed, covered_join
from plumbline.operators.lineage import shared_dir
from plumbline.plans.registry import query, table
from plumbline.sources import formats
from plumbline.sources.tables import exploded, fields, parsed


@query("""WITH m AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations),
    b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN conv_id % 7 = 3 THEN -turn ELSE turn END) AS place FROM conversations WHERE NOT (conv_id % 11 = 5 AND turn = 0))
    SELECT coalesce(m.conv_id, b.conv_id) AS conv_id, count(m.turn) AS n_master, count(b.turn) AS n_block, sum((m.turn = b.turn)::INT)::BIGINT AS n_same, CASE WHEN count(m.turn) = count(b.turn) AND sum((m.turn = b.turn)::INT) = count(m.turn) THEN 'same' ELSE 'DIFFERENT' END AS verdict
    FROM m FULL JOIN b ON m.conv_id = b.conv_id AND m.place = b.place GROUP BY 1""")
def row_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and their order against the master table: places are numbered per case and compared by key. The block has some cases backwards and some without their first row."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    placed = lambda df, order, name: df.select("conv_id", F.col("turn").alias(name), F.row_number().over(Window.partitionBy("conv_id").orderBy(order)).alias("place"))
    master = placed(rows, F.col("turn"), "own")
    block = placed(rows.where("not (conv_id % 11 = 5 and turn = 0)"), F.when(F.col("conv_id") % 7 == 3, -F.col("turn")).otherwise(F.col("turn")), "other")
    counts = master.join(block, ["conv_id", "place"], "full").groupBy("conv_id").agg(F.count("own").alias("n_master"), F.count("other").alias("n_block"), F.count_if(F.col("own") == F.col("other")).alias("n_same"))
    same = (F.col("n_master") == F.col("n_block")) & (F.col("n_same") == F.col("n_master"))
    return counts.withColumn("verdict", F.when(same, "same").otherwise("DIFFERENT"))


@query("""SELECT c.conv_id, c.turn, d.source, d.lang, length(c.text) AS n_chars FROM conversations c JOIN documents d ON d.doc_id = c.conv_id""")
def strict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join that raises where a row has no partner or a key of the block comes twice, and a column of a closed domain that raises on any other value."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "source", closed(F.col("lang"), ["de", "en", "es", "fr"]).alias("lang"))
    return covered_join(turns, docs, ["conv_id"]).select("conv_id", "turn", "source", "lang", F.length("text").cast("long").alias("n_chars"))


@query("""WITH a AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) FILTER (WHERE trim(text) <> '') AS texts, min(turn) AS first FROM conversations GROUP BY conv_id)
    SELECT conv_id, (i - 1)::BIGINT AS i, roles[i] AS role, length(texts[i]) AS n_chars FROM (SELECT *, unnest(range(1, len(roles) + 1)) AS i FROM a WHERE first = 0 AND len(roles) >= 2 AND len(roles) = len(texts))""")
def parallel_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose parallel arrays are there, not empty and of one length, zipped element by element."""
    t = table(spark, sf_dir, "conversations")
    ordered = lambda c, when=None: F.transform(F.sort_array(F.collect_list(F.struct("turn", c) if when is None else F.when(when, F.struct("turn", c)))), lambda x: x[c])
    cases = t.groupBy("conv_id").agg(ordered("role").alias("roles"), ordered("text", F.trim("text") != "").alias("texts"), F.min("turn").alias("first"))
    valid = cases.where((F.col("first") == 0) & (F.size("roles") >= 2) & (F.size("roles") == F.size("texts")))
    each = valid.select("conv_id", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "z"))
    return each.select("conv_id", F.col("i").cast("long").alias("i"), F.col("z.roles").alias("role"), F.length("z.texts").cast("long").alias("n_chars"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), u AS (SELECT DISTINCT user_id FROM c), k AS (SELECT unnest(['click', 'purchase', 'view', 'none']) AS event_type, unnest([0, 0, 0, -1]) AS d),
    f AS (SELECT user_id, event_type, d AS n FROM u, k WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM c) UNION ALL SELECT * FROM c)
    SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts, max(n) FILTER (WHERE event_type = 'purchase') AS purchases FROM f GROUP BY user_id""")
def merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of defaults with a case's own entries over it."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    own = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("own"))
    defaults = F.create_map(*[x for k, v in (("click", 0), ("purchase", 0), ("view", 0), ("none", -1)) for x in (F.lit(k), F.lit(v).cast("long"))])
    both = own.withColumn("all", F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key("own", k)), "own"))
    text = F.array_join(F.transform(F.sort_array(F.map_entries("all")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return both.select("user_id", text.alias("counts"), F.element_at("all", "purchase").alias("purchases"))


@query("""SELECT place::BIGINT AS place, o.event_type, count(e.event_id) AS n, round(avg(value), 6) + 0.0 AS mean FROM (SELECT unnest(['purchase', 'refund', 'click', 'view']) AS event_type, unnest([1, 2, 3, 4]) AS place) o LEFT JOIN events e USING (event_type) GROUP BY 1, 2""")
def ordered_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in a stated order of categories; one without rows keeps its place."""
    order = spark.createDataFrame(list(enumerate(("purchase", "refund", "click", "view"), 1)), "place bigint, event_type string")
    found = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("value")).alias("mean"))
    return order.join(found, "event_type", "left").select("place", "event_type", F.coalesce("n", F.lit(0)).alias("n"), "mean")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25")
def first_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cases in the order of their ids, for smoke runs."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id").limit(25)


@query("""WITH c AS (SELECT 1000 * (max(n_chars) // 1000 + 1) AS cut FROM (SELECT n_chars, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS n FROM documents) WHERE n <= 600) SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents, c WHERE n_chars >= cut GROUP BY text""")
def long_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles beyond the smallest cutoff, each once: the first id of every text."""
    from plumbline.operators.tokens import tokens

    docs = table(spark, sf_dir, "documents")
    cut = docs.select("n_chars", F.size(tokens(F.col("text"))).alias("n")).where("n <= 600").agg((1000 * (F.floor(F.max("n_chars") / 1000) + 1)).alias("cut"))
    long_ = docs.select("doc_id", "n_chars", F.sha2("text", 256).alias("h")).join(F.broadcast(cut), F.col("n_chars") >= F.col("cut"))  # one row
    return long_.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies")).drop("h")


@query("""WITH k AS (SELECT doc_id, source, substr(md5(text), 1, 12) AS id, trim(lang) AS q FROM documents),
    p AS (SELECT a.doc_id, b.doc_id AS match_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY (a.source = b.source) DESC, b.doc_id) AS r, count(*) OVER (PARTITION BY a.doc_id) AS n FROM k a JOIN k b ON a.id = b.id AND a.q = b.q AND a.doc_id <> b.doc_id) SELECT doc_id, match_id, n AS n_candidates FROM p WHERE r = 1""")
def hashed_key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the key (hash of the context, trimmed question): one of the same source if there is any, else the first. Two candidates per key and source suffice, so a key that very many share lists no pairs."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", text_id(F.col("text")).alias("id"), F.trim("lang").alias("q"))
    numbered = rows.withColumn("r", F.row_number().over(Window.partitionBy("id", "q", "source").orderBy("doc_id"))).where("r <= 2")
    own = numbered.groupBy("id", "q", "source").agg(F.sort_array(F.collect_list("doc_id")).alias("mine"))
    two = numbered.withColumn("s", F.row_number().over(Window.partitionBy("id", "q").orderBy("doc_id"))).where("s <= 2")
    all_ = two.groupBy("id", "q").agg(F.sort_array(F.collect_list("doc_id")).alias("all"))
    sizes = rows.groupBy("id", "q").agg(F.count(F.lit(1)).alias("n"))
    both = rows.join(own, ["id", "q", "source"]).join(all_, ["id", "q"]).join(sizes, ["id", "q"]).where("n > 1")
    other = lambda c: F.get(F.filter(c, lambda x: x != F.col("doc_id")), F.lit(0))
    return both.select("doc_id", F.coalesce(other("mine"), other("all")).alias("match_id"), (F.col("n") - 1).alias("n_candidates"))


def checksum(x: Column) -> Column:
    """A sum over rows that does not depend on their order: the first eight hexadecimal digits of each text's md5."""
    return F.sum(F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))


CHECKSUM = "sum(('0x' || substr(md5(text), 1, 8))::BIGINT)::BIGINT"


@query(f"""SELECT source, coalesce(v.version, 'unknown') AS version, count(*) AS n_rows, {CHECKSUM} AS checksum, CASE WHEN count(*) = count(DISTINCT doc_id) AND v.version IS NOT NULL THEN 'ok' ELSE 'FAIL' END AS state
    FROM documents LEFT JOIN (SELECT unnest(['src00', 'src01', 'src02', 'src03']) AS source, unnest(['v1', 'v1', 'v2', 'v3']) AS version) v USING (source) GROUP BY source, v.version""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, checksum and recorded version per part of the corpus; a part without a version fails."""
    versions = spark.createDataFrame([("src00", "v1"), ("src01", "v1"), ("src02", "v2"), ("src03", "v3")], "source string, version string")
    parts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("doc_id").alias("n_ids"), checksum(F.col("text")).alias("checksum"))
    both = parts.join(versions, "source", "left")
    state = F.when((F.col("n_rows") == F.col("n_ids")) & F.col("version").isNotNull(), "ok").otherwise("FAIL")
    return both.select("source", F.coalesce("version", F.lit("unknown")).alias("version"), "n_rows", "checksum", state.alias("state"))


@query("""WITH p AS (SELECT DISTINCT source, lang FROM documents), a AS (SELECT max(n) AS most FROM (SELECT count(*) AS n FROM p GROUP BY source)), b AS (SELECT max(n) AS most FROM (SELECT count(*) AS n FROM p GROUP BY lang)) SELECT a.most AS langs_per_source, b.most AS sources_per_lang, a.most = 1 AND b.most = 1 AS bijection FROM a, b""")
def bijection_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct partners of each key, both ways."""
    pairs = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    most = lambda key, name: pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias(name))
    both = most("source", "langs_per_source").crossJoin(most("lang", "sources_per_lang"))  # single rows
    return both.withColumn("bijection", (F.col("langs_per_source") == 1) & (F.col("sources_per_lang") == 1))


@query(f"""WITH m AS (SELECT count(*) AS n, {CHECKSUM} AS c FROM documents), s AS (SELECT doc_id % 4 AS shard, count(*) AS n, {CHECKSUM} AS checksum FROM documents GROUP BY 1) SELECT shard, s.n AS n_rows, checksum, sum(s.n) OVER () = m.n AND sum(checksum) OVER () = m.c AS complete FROM s, m""")
def shard_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of all shards add up to the master's, so each row is there once and unchanged."""
    docs = table(spark, sf_dir, "documents")
    master = docs.agg(F.count(F.lit(1)).alias("n"), checksum(F.col("text")).alias("c"))
    shards = docs.groupBy((F.col("doc_id") % 4).alias("shard")).agg(F.count(F.lit(1)).alias("n_rows"), checksum(F.col("text")).alias("checksum"))
    every = Window.partitionBy()  # one row per shard
    complete = (F.sum("n_rows").over(every) == F.col("n")) & (F.sum("checksum").over(every) == F.col("c"))
    return shards.join(F.broadcast(master)).select("shard", "n_rows", "checksum", complete.alias("complete"))


@query("""WITH m AS (SELECT vec_id, embedding[1]::DOUBLE AS v, len(embedding) AS n FROM embeddings), b AS (SELECT vec_id, CASE WHEN vec_id % 17 = 0 THEN NULL ELSE embedding[1]::DOUBLE + CASE WHEN vec_id % 5 = 0 THEN 0.001 ELSE 0 END END AS w, len(embedding) - (vec_id % 101 = 7)::INT AS n FROM embeddings WHERE vec_id % 13 <> 0)
    SELECT count(*) AS n_rows, count(b.vec_id) AS covered, (SELECT count(*) FROM b WHERE vec_id NOT IN (SELECT vec_id FROM m)) AS extra, coalesce(sum((m.n <> b.n)::INT), 0)::BIGINT AS n_tok_differs, (count(b.vec_id) - count(w)) AS nan_rows, round(avg(abs(v - w)), 6) + 0.0 AS mean_gap, round(max(abs(v - w)), 6) + 0.0 AS top_gap FROM m LEFT JOIN b USING (vec_id)""")
def alignment_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows covered, token counts that differ, missing values and the differences of two aligned blocks, in one full outer join."""
    x = table(spark, sf_dir, "embeddings")
    master = x.select("vec_id", F.col("embedding")[0].cast("double").alias("v"), F.size("embedding").alias("n"))
    shifted = F.col("embedding")[0].cast("double") + F.when(F.col("vec_id") % 5 == 0, 0.001).otherwise(0.0)
    block = x.where("vec_id % 13 <> 0").select("vec_id", F.when(F.col("vec_id") % 17 != 0, shifted).alias("w"), (F.size("embedding") - (F.col("vec_id") % 101 == 7).cast("int")).alias("k"), F.lit(True).alias("b"))
    both = master.join(block, "vec_id", "full")
    gap = F.abs(F.col("v") - F.col("w"))
    return both.agg(F.count("n").alias("n_rows"), F.count_if(F.col("n").isNotNull() & F.col("b")).alias("covered"), F.count_if(F.col("n").isNull()).alias("extra"), F.count_if(F.col("n") != F.col("k")).alias("n_tok_differs"), F.count_if(F.col("b") & F.col("w").isNull()).alias("nan_rows"), rounded(F.avg(gap)).alias("mean_gap"), rounded(F.max(gap)).alias("top_gap"))


@query("""SELECT event_id, round_even(round(value * 4) / 4, 1) + 0.0 AS even, regexp_replace(printf('%.3f', (event_id % 1994 - 997) / 997.0), '^(-?)0\\.', '\\1.') AS short, printf('%.0f%%', (event_id % 997) * 100 / 997.0) AS percent, ('{"a": {"b": {"c": ' || event_id % 7 || '}}}')::JSON->'a'->'b'->>'c' AS nested FROM events""")
def rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties rounded to the even digit, numbers without their leading zero, whole per cents, a value two levels down in JSON."""
    k = F.col("event_id")
    short = F.regexp_replace(F.format_string("%.3f", (k % 1994 - 997) / F.lit(997.0)), r"^(-?)0\.", "$1.")
    text = F.concat(F.lit('{"a": {"b": {"c": '), (k % 7).cast("string"), F.lit("}}}"))
    nested = F.from_json(text, "a struct<b: struct<c: string>>")["a"]["b"]["c"]
    return table(spark, sf_dir, "events").select("event_id", (F.bround(F.round(F.col("value") * 4) / 4, 1) + F.lit(0.0)).alias("even"), short.alias("short"), F.format_string("%.0f%%", (k % 997) * 100 / F.lit(997.0)).alias("percent"), nested.alias("nested"))


@query("""WITH g AS (SELECT source, lang, count(*) AS n, max(n_chars) AS longest, sum(l.toxic)::BIGINT AS toxic FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2)
    SELECT source, lang, n, toxic, CASE WHEN n > 1 THEN longest END AS longest, CASE WHEN toxic IS NULL THEN 'OBJECT<n: BIGINT' ELSE 'OBJECT<labels: OBJECT<toxic: BIGINT>, n: BIGINT' END || CASE WHEN n > 1 THEN ', spread: OBJECT<longest: BIGINT>>' ELSE '>' END AS shape FROM g""")
def variant_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports per source whose members and fields depend on the data, read back without a schema: members of an object, fields by their path, and the shape of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    each = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"), F.sum("toxic").alias("toxic"))
    held = F.struct("n", F.when(F.col("toxic").isNotNull(), F.struct("toxic")).alias("labels"), F.when(F.col("n") > 1, F.struct("longest")).alias("spread"))
    reports = each.groupBy("source").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("lang", held))).alias("langs"))).alias("text"))
    told = exploded(parsed(reports, "text"), "report", "$.langs").select("source", F.col("key").alias("lang"), "value", F.schema_of_variant("value").alias("shape"))
    return fields(told, "value", {"n": ("$.n", "bigint"), "toxic": ("$.labels.toxic", "bigint"), "longest": ("$.spread.longest", "bigint")}).drop("value")


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 4) + 0.0 AS total, len(embedding) AS n FROM embeddings""")
def archived_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature block written as archives of named arrays and scanned back: only what is named, in row ranges."""
    formats.register(spark)
    path = shared_dir(spark)
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("block"), F.lit(0).alias("unused"))
    own.write.format("npz").mode("append").save(path)
    back = spark.read.format("npz").option("rowsPerPartition", 4096).schema("vec_id long, block array<float>").load(path)
    total = F.aggregate("block", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return back.select("vec_id", (F.round(total, 4) + F.lit(0.0)).alias("total"), F.size("block").cast("long").alias("n"))
