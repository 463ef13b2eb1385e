"""Tokens with their places: kept contexts, sentences' tokens, the context inside a prompt, joined documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import scalar
from plumbline.operators import subwords
from plumbline.operators.intervals import held_points, sentence_places, times_held
from plumbline.operators.tokens import kept_context, offsets, stops_at, token_starts
from plumbline.plans.registry import query, table
from plumbline.plans.windows import SPANS, sentence_rows

WS = r" \t\n\x0B\f\r"
#: Tokens with their places, from the runs of tokens and blanks in turn.
TOKENS = f"""g AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^{WS}]+|[{WS}]+') AS p FROM documents)),
    h AS (SELECT doc_id, i, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM g),
    k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS tok, (e - length(piece))::BIGINT AS t_start, e::BIGINT AS t_end FROM h WHERE NOT regexp_matches(piece, '[{WS}]'))"""


def token_table(docs: DataFrame) -> DataFrame:
    """(doc_id, tok, t_start, t_end): one row per token."""
    o = docs.select("doc_id", offsets("text").alias("o"))
    each = o.select("doc_id", F.posexplode(F.arrays_zip("o.starts", "o.ends")).alias("tok", "t"))
    return each.select("doc_id", F.col("tok").cast("long").alias("tok"), F.col("t.starts").cast("long").alias("t_start"), F.col("t.ends").cast("long").alias("t_end"))


@query(f"WITH {TOKENS} SELECT * FROM k")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every text with its half-open place."""
    return token_table(table(spark, sf_dir, "documents"))


@query(f"""WITH {TOKENS}, e AS (SELECT doc_id, t_end FROM k WHERE tok = 511) SELECT d.doc_id, (e.doc_id IS NOT NULL) AS cut, length(CASE WHEN e.doc_id IS NULL THEN text ELSE substr(text, 1, t_end) END) AS n_chars,
    md5(CASE WHEN e.doc_id IS NULL THEN text ELSE substr(text, 1, t_end) END) AS digest FROM documents d LEFT JOIN e USING (doc_id)""")
def retained_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What window 1 retains: up to the end of token 512, or the whole text where there are fewer."""
    own = table(spark, sf_dir, "documents").select("doc_id", "text", offsets("text")["ends"].alias("ends"))
    kept = own.select("doc_id", (F.size("ends") >= 512).alias("cut"), kept_context(F.col("text"), F.col("ends"), 512).alias("kept"))
    return kept.select("doc_id", "cut", F.length("kept").cast("long").alias("n_chars"), F.md5("kept").alias("digest"))


def with_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, the tokens' starts, and the range of tokens that start inside each sentence."""
    own = docs.select("doc_id", "text", token_starts("text").alias("starts"), sentence_places("text").alias("s"))
    return own.select("doc_id", "text", "starts", held_points("starts", "s.starts", "s.ends").alias("r"))


@query(f"""WITH {TOKENS}, {SPANS} SELECT s.doc_id, s.k::BIGINT AS sent, count(*) AS n_tok, min(tok) AS first, max(tok) AS last FROM k JOIN s ON s.doc_id = k.doc_id AND t_start >= s_start AND t_start < s_end GROUP BY 1, 2 HAVING count(*) >= 3""")
def sentence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens that start inside each sentence; sentences of fewer than three are skipped."""
    own = with_sentences(table(spark, sf_dir, "documents")).select("doc_id", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))
    each = sentence_rows(own, "lo", "hi").where("hi - lo >= 3")
    return each.select("doc_id", F.col("k").alias("sent"), (F.col("hi") - F.col("lo")).cast("long").alias("n_tok"), F.col("lo").cast("long").alias("first"), (F.col("hi") - 1).cast("long").alias("last"))


@query(f"""WITH {TOKENS}, {SPANS}, m AS (SELECT k.doc_id, tok, t_start, count(s.k) AS n FROM k LEFT JOIN s ON s.doc_id = k.doc_id AND t_start >= s_start AND t_start < s_end GROUP BY 1, 2, 3),
    z AS (SELECT s.doc_id, s.k, count(k.tok) AS n FROM s LEFT JOIN k ON s.doc_id = k.doc_id AND t_start >= s_start AND t_start < s_end GROUP BY 1, 2)
    SELECT count(*) AS n_tokens, count(*) FILTER (n = 1) AS in_one, count(*) FILTER (n = 0 AND substr(text, t_start + 1, 1) IN ('.', '!', '?')) AS stops, count(*) FILTER (n = 0 AND substr(text, t_start + 1, 1) NOT IN ('.', '!', '?')) AS in_none, count(*) FILTER (n > 1) AS in_several,
    (SELECT count(*) FROM z) AS n_spans, (SELECT count(*) FROM z WHERE n = 0) AS empty_spans FROM m JOIN documents USING (doc_id)""")
def span_coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens lie in exactly one sentence, are stops between sentences, lie in none or in several, and how many sentences hold none."""
    own = with_sentences(table(spark, sf_dir, "documents"))
    own = own.select("starts", "r", F.arrays_zip(times_held("starts", "r.lo", "r.hi").alias("n"), stops_at("text", "starts").alias("stop")).alias("t"))
    held = F.zip_with("r.lo", "r.hi", lambda a, b: b > a)
    total = lambda x, f, name: F.sum(F.size(F.filter(x, f))).alias(name)
    return own.agg(
        F.sum(F.size("starts")).alias("n_tokens"), total("t", lambda t: t["n"] == 1, "in_one"), total("t", lambda t: (t["n"] == 0) & t["stop"], "stops"), total("t", lambda t: (t["n"] == 0) & ~t["stop"], "in_none"),
        total("t", lambda t: t["n"] > 1, "in_several"), F.sum(F.size(held)).alias("n_spans"), total(held, lambda x: ~x, "empty_spans"),
    )


@query(f"""WITH p AS (SELECT doc_id, length(text) AS n, regexp_extract_all('Context:' || chr(10) || text || chr(10) || chr(10) || 'Question: ' || source || chr(10) || chr(10) || 'Answer: ', '[^{WS}]+|[{WS}]+') AS p FROM documents),
    g AS (SELECT doc_id, n, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM p), h AS (SELECT doc_id, n, i, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM g),
    k AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS tok, e - length(piece) AS s FROM h WHERE NOT regexp_matches(piece, '[{WS}]'))
    SELECT doc_id, min(tok) FILTER (WHERE s >= 9 AND s < 9 + n) AS first, max(tok) FILTER (WHERE s >= 9 AND s < 9 + n) AS last, count(*) AS n_prompt FROM k GROUP BY doc_id""")
def context_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last token of the prompt that start inside its context, which begins at the same place in every prompt; NULL where none does."""
    begin = len("Context:\n")
    own = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), token_starts(scalar.prompt(F.col("text"), F.col("source"))).alias("starts"))
    place = F.filter(F.transform("starts", lambda s, i: F.when((s >= begin) & (s < begin + F.col("n")), i)), lambda i: i.isNotNull())
    return own.select("doc_id", F.array_min(place).cast("long").alias("first"), F.array_max(place).cast("long").alias("last"), F.size("starts").cast("long").alias("n_prompt"))


@query(f"""WITH {TOKENS}, a AS (SELECT doc_id, count(*) AS n, max(t_end) FILTER (WHERE tok < 256) AS upto FROM k GROUP BY doc_id HAVING count(*) >= 8) SELECT a.doc_id, least(n, 256) AS n_read, n > 256 AS cut, md5(substr(text, 1, upto)) AS digest FROM a JOIN documents d USING (doc_id)""")
def answer_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers cut at 256 tokens; those of fewer than eight are skipped."""
    own = table(spark, sf_dir, "documents").select("doc_id", "text", offsets("text")["ends"].alias("ends")).where(F.size("ends") >= 8)
    n = F.least(F.size("ends"), F.lit(256))
    return own.select("doc_id", n.cast("long").alias("n_read"), (F.size("ends") > 256).alias("cut"), F.md5(F.substring("text", F.lit(1), F.get("ends", n - 1))).alias("digest"))


@query("""WITH t AS (SELECT conv_id, turn, text, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 1 AS place FROM conversations), j AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS whole FROM conversations GROUP BY conv_id)
    SELECT conv_id, turn, place::BIGINT AS place, substr(whole, place::BIGINT + 1, length(text)) = text AS found, md5(whole) AS digest FROM t JOIN j USING (conv_id)""")
def joined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case's documents joined by line feeds, and the place where each begins."""
    t = table(spark, sf_dir, "conversations")
    run = F.sum(F.length("text") + 1).over(Window.partitionBy("conv_id").orderBy("turn")) - F.length("text") - 1
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")))
    whole = t.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("whole"))
    both = t.withColumn("place", run).join(whole, "conv_id")
    return both.select("conv_id", "turn", F.col("place").cast("long").alias("place"), (F.substring("whole", F.col("place").cast("int") + 1, F.length("text")) == F.col("text")).alias("found"), F.md5("whole").alias("digest"))


@query(f"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[{WS}]+|[^{WS}]+') AS p FROM documents), g AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM p),
    h AS (SELECT doc_id, i, piece, regexp_matches(piece, '[{WS}]') AS blank, sum(length(piece)) OVER w - length(piece) AS own, sum(CASE WHEN regexp_matches(piece, '[{WS}]') THEN 1 ELSE length(piece) END) OVER w AS flat_end FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    SELECT doc_id, (flat_end - length(piece))::BIGINT AS flat, own::BIGINT AS own FROM h WHERE NOT blank""")
def collapsed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space collapsed to single blanks, with the way back: where each run of other signs begins in the collapsed and in the own text."""
    o = table(spark, sf_dir, "documents").select("doc_id", offsets("text").alias("o"))
    # in the collapsed text a run begins after the runs before it, a blank each, and a blank if the text begins with white space
    each = o.select("doc_id", F.col("o.starts")[0].alias("lead"), F.posexplode(F.arrays_zip("o.starts", "o.ends")).alias("i", "t"))
    before = F.coalesce(F.sum(F.col("t.ends") - F.col("t.starts")).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.select("doc_id", (before + F.col("i") + (F.col("lead") > 0).cast("int")).cast("long").alias("flat"), F.col("t.starts").cast("long").alias("own"))


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '')) AS p, generate_subscripts(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> ''), 1) AS i FROM documents),
    n AS (SELECT doc_id, i, p, len(regexp_extract_all(p, '[^ \t\n\x0B\f\r]+')) AS n FROM t), r AS (SELECT doc_id, i, p, n, sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS before FROM n)
    SELECT doc_id, (before // 256)::BIGINT AS chunk, count(*) AS n_passages, sum(n)::BIGINT AS n_tokens, md5(string_agg(p, chr(10) ORDER BY i)) AS digest FROM r GROUP BY 1, 2""")
def passage_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank passages of a text in groups: a passage belongs to the group in which its first token falls, 256 tokens a group."""
    from plumbline.operators.tokens import tokens

    passages = F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "")
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(passages).alias("i", "p")).withColumn("n", F.size(tokens(F.col("p"))))
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("i")) - F.col("n")
    groups = each.withColumn("chunk", F.floor(before / 256)).groupBy("doc_id", "chunk")
    return groups.agg(F.count(F.lit(1)).alias("n_passages"), F.sum("n").cast("long").alias("n_tokens"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]), "\n")).alias("digest"))


CHUNKS = 5


@query(f"""WITH {TOKENS}, n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id), c AS (SELECT k.doc_id, t_start, t_end, tok, ((tok + 1) * {CHUNKS} + n - 1) // n - 1 AS chunk FROM k JOIN n USING (doc_id)),
    r AS (SELECT doc_id, chunk::BIGINT AS chunk, min(tok) AS first, count(*) AS n_tokens, min(t_start) AS c_start, max(t_end) AS c_end FROM c GROUP BY 1, 2)
    SELECT r.doc_id, chunk, first, n_tokens, c_start, c_end, md5(substr(text, c_start + 1, c_end - c_start)) AS digest FROM r JOIN documents USING (doc_id)""")
def context_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context in five runs of tokens as even as can be, cut at tokens; one of fewer tokens has fewer. Each chunk is a pass of its own whose signals are compared with the whole's."""
    own = table(spark, sf_dir, "documents").select("doc_id", "text", offsets("text").alias("o")).withColumn("n", F.size("o.starts"))
    cuts = F.transform(F.sequence(F.lit(0), F.lit(CHUNKS)), lambda i: F.floor(i * F.col("n") / CHUNKS).cast("int"))
    each = own.withColumn("cuts", cuts).select("doc_id", "text", "o", "cuts", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))).alias("chunk"))
    each = each.select("doc_id", "text", "o", "chunk", F.get("cuts", F.col("chunk")).alias("lo"), F.get("cuts", F.col("chunk") + 1).alias("hi")).where("hi > lo")
    placed = each.select("doc_id", "text", F.col("chunk").cast("long").alias("chunk"), F.col("lo").cast("long").alias("first"), (F.col("hi") - F.col("lo")).cast("long").alias("n_tokens"), F.get("o.starts", F.col("lo")).cast("long").alias("c_start"), F.get("o.ends", F.col("hi") - 1).cast("long").alias("c_end"))
    return placed.select("doc_id", "chunk", "first", "n_tokens", "c_start", "c_end", F.md5(F.substring("text", F.col("c_start").cast("int") + 1, (F.col("c_end") - F.col("c_start")).cast("int"))).alias("digest"))


def vocabulary(path: str | None = None) -> str:
    """The path of a byte-level tokenizer's file, by default that of the installed library."""
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("byte_bpe_50k.json"))
    return path


@query()
def subword_offsets(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Subword tokens of every text with their places, and those that start inside each sentence; tokenizers are beyond SQL."""
    held = subwords.subwords_in_sentences(table(spark, sf_dir, "documents"), vocabulary(path))
    digest = lambda c: F.md5(F.concat_ws(",", c.cast("array<string>")))
    most = F.array_max(F.zip_with("hi", "lo", lambda a, b: a - b))
    return held.select("doc_id", F.size("starts").cast("long").alias("n_tokens"), digest(F.col("starts")).alias("starts"), digest(F.col("ends")).alias("ends"), F.coalesce(most, F.lit(0)).cast("long").alias("longest_sentence"))


@query()
def subword_limits(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """How much of each text a prompt of 1024 subword tokens holds beside the question and an answer, which are here the source and its first 200 signs."""
    fit = subwords.longest_fit(vocabulary(path), 1024, "Context:\n", "\n\nQuestion: ", "\n\nAnswer: ")
    own = table(spark, sf_dir, "documents").select("doc_id", fit("text", F.coalesce("source", F.lit("")), F.substring("text", 1, 200)).alias("f"))
    return own.select("doc_id", *[F.col(f"f.{c}").cast("long").alias(c) for c in ("n_tokens", "read_tokens", "read_chars", "seq_len")], "f.cut")
