"""String operators: labels, white space, paragraphs, ids, prompts, number rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalar
from plumbline.plans.registry import query, table


@query("""SELECT conv_id, turn, replace(replace(lower(regexp_replace(regexp_replace(' ' || role || '_Turn ', '^\\s+', ''), '\\s+$', '')), '_', '-'), ' ', '-') AS label, role IN ('user', 'assistant') AS known FROM conversations""")
def normal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.col("role"), F.lit("_Turn "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scalar.normal_label(raw).alias("label"), F.col("role").isin("user", "assistant").alias("known"))


@query("""SELECT doc_id, length(regexp_replace(text, '\\s+', ' ', 'g')) AS n_squeezed, greatest(1, len(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '')))::BIGINT AS n_paragraphs,
    md5('Context:' || chr(10) || text || chr(10) || chr(10) || 'Question: ' || source || chr(10) || chr(10) || 'Answer: ') AS prompt FROM documents""")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(scalar.collapse(F.col("text"))).cast("long").alias("n_squeezed"), F.size(scalar.clean_paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"), F.md5(scalar.prompt(F.col("text"), F.col("source"))).alias("prompt")
    )


@query("""SELECT event_id, printf('%+.3f', value) AS signed, printf('%.3f%%', least(value, 1000)) AS percent, string_split(event_type || '_x_K5', '_')[-1] AS tag FROM events""")
def number_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.format_string("%+.3f", v).alias("signed"), F.format_string("%.3f%%", F.least(v, F.lit(1000.0))).alias("percent"), F.element_at(F.split(F.concat("event_type", F.lit("_x_K5")), "_"), -1).alias("tag"))


@query("""SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)', 2) AS host, len(regexp_extract_all(html, '<[a-zA-Z]+'))::BIGINT AS n_tags, sha256(html) AS digest FROM pages""")
def page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^(https?)://([^/]+)", 2).alias("host"), F.size(F.regexp_extract_all("html", F.lit("<[a-zA-Z]+"), F.lit(0))).cast("long").alias("n_tags"), F.sha2("html", 256).alias("digest"))


@query("""SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn) AS roles, max(length(text)) AS longest, left(min(text), 5) AS first FROM conversations GROUP BY conv_id HAVING count(*) >= 2""")
def conversation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    found = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), roles.alias("roles"), F.max(F.length("text")).cast("long").alias("longest"), F.left(F.min("text"), F.lit(5)).alias("first"))
    return found.where("n_turns >= 2")
