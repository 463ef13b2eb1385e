"""Token windows, bins, spans, donors and displaced contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import scalar
from plumbline.functions.scalar import rounded
from plumbline.operators import bins
from plumbline.operators.intervals import any_in, best_in, held_points, met_spans, sentence_places
from plumbline.operators.lineage import written
from plumbline.operators.matching import containing
from plumbline.operators.quantiles import with_order_statistics
from plumbline.operators.sampling import donors, prefix_donors
from plumbline.operators.tokens import first_tokens, n_windows, offsets, places_in, tokens, windows
from plumbline.plans.registry import query, table

TOKENS = r"len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'))"
WORDS = f"w AS (SELECT doc_id, source, n_chars, text, {TOKENS} AS n FROM documents)"


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "n_chars", F.size(tokens(F.col("text"))).cast("long").alias("n"))


@query(f"""WITH {WORDS}, k AS (SELECT doc_id, n, CASE WHEN n <= 0 THEN 0 WHEN n <= 512 THEN 1 ELSE 1 + ceil((n - 512) / 384.0) END::BIGINT AS k FROM w)
    SELECT doc_id, win, win * 384 AS start, least(win * 384 + 512, n) AS "end" FROM (SELECT doc_id, n, unnest(range(k)) AS win FROM k)""")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(counted(spark, sf_dir), "n", 512, 128).select("doc_id", "win", "start", "end")


@query(f"""WITH {WORDS} SELECT doc_id, n AS n_tokens, CASE WHEN n <= 0 THEN 0 WHEN n <= 512 THEN 1 ELSE 1 + ceil((n - 512) / 384.0) END::BIGINT AS n_windows,
    least(n, 512) AS read_tokens, n > 512 AS cut, CASE WHEN n > 0 THEN least(n, 512) / n::DOUBLE END AS ctx_kept FROM w""")
def window_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return counted(spark, sf_dir).select("doc_id", n.alias("n_tokens"), n_windows(n, 512, 128).alias("n_windows"), F.least(n, F.lit(512)).alias("read_tokens"), (n > 512).alias("cut"), F.try_divide(F.least(n, F.lit(512)).cast("double"), n).alias("ctx_kept"))


@query("""SELECT event_id, 1 + (3 * (r - 1) > n - 1)::BIGINT + (3 * (r - 1) > 2 * (n - 1))::BIGINT AS tertile FROM
    (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)""")
def tertile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.tertiles(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), ["event_type"], "value", ("event_id",)).select("event_id", "tertile")


@query("""WITH e AS (SELECT quantile_cont(n_chars, [0, 0.25, 0.5, 0.75, 1]) AS q FROM documents) SELECT greatest(1, len(list_filter(list_distinct(q), lambda v: v < n_chars)))::BIGINT AS bin, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high
    FROM documents, e GROUP BY 1""")
def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = bins.quantile_bins(table(spark, sf_dir, "documents").select("n_chars"), [], "n_chars", 4)
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))


@query("""SELECT CASE WHEN n_chars > 0 AND n_chars <= 500 THEN 0 WHEN n_chars > 500 AND n_chars <= 2000 THEN 1 WHEN n_chars > 2000 AND n_chars <= 8000 THEN 2 END::BIGINT AS bin,
    count(*) AS n, median(n_chars) AS middle, min(n_chars) || '-' || max(n_chars) AS span FROM documents GROUP BY 1""")
def cut_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("n_chars", bins.cut(F.col("n_chars"), [0, 500, 2000, 8000]).alias("bin"))
    found = docs.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.concat_ws("-", F.min("n_chars").cast("string"), F.max("n_chars").cast("string")).alias("span"))
    return with_order_statistics(found, docs, ["bin"], "n_chars", [0.5], ["middle"])


@query("""SELECT user_id, day, total, round(avg(total) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) + 0.0 AS smooth, sum(n) OVER (PARTITION BY user_id ORDER BY day)::BIGINT AS seen
    FROM (SELECT user_id, (date_diff('day', TIMESTAMP '2024-01-01', ts))::BIGINT AS day, round(sum(value), 6) + 0.0 AS total, count(*) AS n FROM events GROUP BY 1, 2)""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    daily = table(spark, sf_dir, "events").groupBy("user_id", day.alias("day")).agg(rounded(F.sum("value")).alias("total"), F.count(F.lit(1)).alias("n"))
    out = bins.smoothed(daily, ["user_id"], "day", "total", "smooth")
    return out.withColumns({"smooth": rounded(F.col("smooth")), "seen": F.sum("n").over(Window.partitionBy("user_id").orderBy("day"))}).drop("n")


SENTENCE = r"[^.!?\n]+[.!?]*"
#: Sentences with their places: a text falls into sentences and what is between them, and lengths add up to places.
SPANS = f"""pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{SENTENCE}|[.!?\n]+') AS p FROM documents)),
    ends AS (SELECT doc_id, i, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS s_end FROM pieces),
    s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, piece, (s_end - length(piece))::BIGINT AS s_start, s_end::BIGINT AS s_end FROM ends WHERE left(piece, 1) NOT IN ('.', '!', '?', chr(10)))"""


def sentence_rows(df: DataFrame, *columns: str) -> DataFrame:
    """One row per element of array columns of equal length: doc_id, k, and the columns' elements."""
    each = df.select("doc_id", F.posexplode(F.arrays_zip(*columns)).alias("k", "z"))
    return each.select("doc_id", F.col("k").cast("long").alias("k"), *[F.col(f"z.{c}").alias(c) for c in columns])


def with_points(docs: DataFrame) -> DataFrame:
    """doc_id, places of sentences, every fiftieth sign as sorted points, and the range of points in each sentence."""
    every = F.when(F.col("n_chars") > 0, F.sequence(F.lit(0), F.col("n_chars").cast("int") - 1, F.lit(50))).otherwise(F.array().cast("array<int>"))
    own = docs.select("doc_id", sentence_places("text").alias("s"), every.alias("points"))
    return own.withColumn("r", held_points("points", "s.starts", "s.ends"))


@query(f"""WITH {SPANS}, t AS (SELECT doc_id, unnest(range(0, n_chars, 50)) AS p FROM documents) SELECT s.doc_id, s.k::BIGINT AS k, count(*) AS n_points, min(p) AS first, max(p) AS last
    FROM t JOIN s ON s.doc_id = t.doc_id AND p >= s_start AND p < s_end GROUP BY 1, 2""")
def span_token_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in half-open spans, inside each case: a span's points are a range of the sorted ones."""
    own = with_points(table(spark, sf_dir, "documents")).select("doc_id", "points", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))
    own = own.select("doc_id", "lo", "hi", F.transform("lo", lambda i: F.get("points", i)).alias("first"), F.transform("hi", lambda i: F.get("points", i - 1)).alias("last"))
    each = sentence_rows(own, "lo", "hi", "first", "last").where("hi > lo")
    return each.select("doc_id", "k", (F.col("hi") - F.col("lo")).cast("long").alias("n_points"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query(f"""WITH {SPANS}, b AS (SELECT doc_id, i, i * 300 AS b_start, i * 300 + 120 AS b_end, i % 3 = 0 AS bad FROM (SELECT doc_id, unnest(range(n_chars // 300 + 1)) AS i FROM documents))
    SELECT s.doc_id, s.k::BIGINT AS k, count(*) AS n_met, bool_or(bad) AS bad FROM s JOIN b ON s.doc_id = b.doc_id AND b_end > s_start AND b_start < s_end GROUP BY 1, 2""")
def span_overlap_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence is bad if any bad span overlaps it."""
    i = F.sequence(F.lit(0), F.floor(F.col("n_chars") / 300).cast("int"))
    own = table(spark, sf_dir, "documents").select("doc_id", sentence_places("text").alias("s"), i.alias("i"))
    own = own.select("doc_id", "i", met_spans("s.starts", "s.ends", F.transform("i", lambda x: x * 300), F.transform("i", lambda x: x * 300 + 120)).alias("r"))
    own = own.select("doc_id", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"), any_in(F.transform("i", lambda x: x % 3 == 0), "r.lo", "r.hi").alias("bad"))
    return sentence_rows(own, "lo", "hi", "bad").where("hi > lo").select("doc_id", "k", (F.col("hi") - F.col("lo")).cast("long").alias("n_met"), "bad")


DONORS = f"""{WORDS}, c AS (SELECT doc_id, source, doc_id % 2 AS split, CASE WHEN n <= 512 THEN 1 ELSE 1 + ceil((n - 512) / 384.0) END::BIGINT AS k FROM w WHERE n > 512),
    e AS (SELECT a.doc_id, a.k, b.doc_id AS donor, b.k AS donor_k, row_number() OVER (PARTITION BY a.doc_id ORDER BY b.k DESC, b.doc_id) - 1 AS r, count(*) OVER (PARTITION BY a.doc_id) AS m
    FROM c a JOIN c b ON a.split = b.split AND a.source <> b.source AND b.k >= a.k),
    p AS (SELECT doc_id, k, donor, donor_k, false AS fallback FROM e WHERE r = ((doc_id * 1103515245 + 12345) % 2147483648 // 65536) % m),
    f AS (SELECT a.doc_id, a.k, max(struct_pack(k := b.k, i := b.doc_id)) AS t FROM c a JOIN c b ON a.split = b.split AND a.source <> b.source WHERE a.doc_id NOT IN (SELECT doc_id FROM e) GROUP BY 1, 2),
    picked AS (SELECT * FROM p UNION ALL SELECT doc_id, k, t.i, t.k, true FROM f)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with tokens, their split and number of windows; tokens are counted once."""
    own = counted(spark, sf_dir).where("n > 0")
    return written(own.select("doc_id", "source", (F.col("doc_id") % 2).alias("split"), n_windows(F.col("n"), 512, 128).alias("k")))


@query(f"WITH {DONORS} SELECT * FROM picked")
def donor_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each case of two windows or more a seeded donor of another source, the same split and enough windows; else the one with most windows."""
    return donors(cases(spark, sf_dir), "doc_id", "source", "split", "k")


@query(f"""WITH {DONORS} SELECT count(*) AS n, sum((a.source = b.source)::INT)::BIGINT AS same_source, sum((a.split <> b.split)::INT)::BIGINT AS other_split, sum((NOT fallback AND donor_k < picked.k)::INT)::BIGINT AS too_few, sum(fallback::INT)::BIGINT AS fallbacks
    FROM picked JOIN c a ON a.doc_id = picked.doc_id JOIN c b ON b.doc_id = donor""")
def donor_rule_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cases(spark, sf_dir)
    picked = donors(own, "doc_id", "source", "split", "k")
    other = own.select(F.col("doc_id").alias("donor"), F.col("source").alias("source_b"), F.col("split").alias("split_b"))
    both = picked.join(own.select("doc_id", "source", "split"), "doc_id").join(other, "donor")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == F.col("source_b")).alias("same_source"), F.count_if(F.col("split") != F.col("split_b")).alias("other_split"), F.count_if(~F.col("fallback") & (F.col("donor_k") < F.col("k"))).alias("too_few"), F.count_if("fallback").alias("fallbacks"))


def read_windows(picked: DataFrame) -> DataFrame:
    """(doc_id, win, from_doc, from_win): window 1 is the case's own; the others are its donor's from the second on, in turn."""
    each = picked.withColumn("win", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    own = F.col("win") == 0
    turn = 1 + F.try_mod(F.col("win") - 1, F.col("donor_k") - 1)
    return each.select("doc_id", "win", F.when(own, F.col("doc_id")).otherwise(F.col("donor")).alias("from_doc"), F.when(own, F.col("win")).otherwise(turn).alias("from_win"))


@query(f"""WITH {DONORS} SELECT doc_id, win, CASE WHEN win = 0 THEN doc_id ELSE donor END AS from_doc, CASE WHEN win = 0 THEN win ELSE 1 + (win - 1) % (donor_k - 1) END AS from_win
    FROM (SELECT *, unnest(range(k)) AS win FROM picked)""")
def placebo_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_windows(donors(cases(spark, sf_dir), "doc_id", "source", "split", "k"))


BUDGET = 1808
DISPLACED = f"""{WORDS}, c AS (SELECT doc_id, source, doc_id % 2 AS split, n, text FROM w WHERE n > 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id * 7919 % 1000003, doc_id) - 1 AS at, count(*) OVER (PARTITION BY split) AS m FROM c),
    q AS (SELECT a.doc_id, b.doc_id AS donor, b.n, b.text, (b.at - ((a.doc_id * 1103515245 + 12345) % 2147483648 // 65536) % a.m + a.m) % a.m AS place FROM o a JOIN o b ON a.split = b.split AND a.source <> b.source WHERE a.n <= 1800),
    r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM q),
    u AS (SELECT doc_id, place, donor, before, least(n, {BUDGET} - before) AS used, text FROM r WHERE before < {BUDGET})"""


def displaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose context fits one window of 1800 tokens with their prefix donors, which may be of any size."""
    every = written(counted(spark, sf_dir).where("n > 0").select(F.col("doc_id").alias("id"), F.col("source").alias("src"), (F.col("doc_id") % 2).alias("part"), F.col("n").alias("size")))
    return prefix_donors(every.where("size <= 1800").drop("size"), every, BUDGET).withColumnRenamed("id", "doc_id")


@query(f"WITH {DISPLACED} SELECT doc_id, donor, before, used FROM u")
def displaced_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of other sources in a seeded order until a token budget; the last is cut at the budget."""
    return displaced(spark, sf_dir).select("doc_id", "donor", "before", "used")


@query(f"""WITH {DISPLACED}, x AS (SELECT doc_id, place, before + used AS upto, CASE WHEN before + used < {BUDGET} THEN text ELSE array_to_string(list_slice(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+'), 1, CASE WHEN regexp_matches(text, '^[ \t\n\x0B\f\r]') THEN 2 * used ELSE 2 * used - 1 END), '') END AS part FROM u),
    t AS (SELECT doc_id, count(*) AS n_donors, max(upto) AS n_prefix, string_agg(part, chr(10) || chr(10) ORDER BY place) AS prefix FROM x GROUP BY doc_id)
    SELECT t.doc_id, n_donors, n_prefix, n_prefix = {BUDGET} AS enough, length(prefix) AS n_chars, md5(prefix || chr(10) || chr(10) || c.text) AS digest FROM t JOIN c ON c.doc_id = t.doc_id""")
def displaced_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The displaced contexts: the donors' texts joined by blank lines, cut at the end of the last token of the budget, a blank line, the own text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    taken = displaced(spark, sf_dir).join(docs.withColumnRenamed("doc_id", "donor").hint("merge"), "donor")  # texts, and rows per text, are never broadcast
    upto = F.col("before") + F.col("used")
    whole = taken.where(upto < BUDGET).select("doc_id", "place", upto.alias("upto"), F.col("text").alias("part"))
    last = taken.where(upto >= BUDGET).select("doc_id", "place", upto.alias("upto"), first_tokens(F.col("text"), offsets("text")["ends"], F.col("used")).alias("part"))  # only these need their tokens' places
    parts = whole.unionByName(last).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_donors"), F.max("upto").alias("n_prefix"), F.sort_array(F.collect_list(F.struct("place", "part"))).alias("p"))
    prefix = parts.withColumn("prefix", F.array_join("p.part", "\n\n")).join(docs.hint("merge"), "doc_id")
    return prefix.select("doc_id", "n_donors", "n_prefix", (F.col("n_prefix") == BUDGET).alias("enough"), F.length("prefix").cast("long").alias("n_chars"), F.md5(F.concat("prefix", F.lit("\n\n"), "text")).alias("digest"))


@query(f"""WITH {DISPLACED}, t AS (SELECT u.doc_id, sum(used) AS n, bool_and(a.source <> b.source AND a.split = b.split) AS fine FROM u JOIN c a ON a.doc_id = u.doc_id JOIN c b ON b.doc_id = u.donor GROUP BY u.doc_id)
    SELECT count(*) AS n_cases, sum((t.n = {BUDGET})::INT)::BIGINT AS n_full, sum((least(1800, t.n + w.n) <= t.n)::INT)::BIGINT AS window1_before, sum(fine::INT)::BIGINT AS donors_ok FROM t JOIN w USING (doc_id)""")
def displacement_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window 1 of a displaced context ends before the original begins, the prefix has its budget, donors keep the rule."""
    own = written(counted(spark, sf_dir).where("n > 0").select("doc_id", "source", (F.col("doc_id") % 2).alias("split"), "n"))
    taken = displaced(spark, sf_dir)
    other = own.select(F.col("doc_id").alias("donor"), F.col("source").alias("source_b"), F.col("split").alias("split_b"))
    both = taken.join(own, "doc_id").join(other, "donor")
    each = both.groupBy("doc_id", F.col("n").alias("own")).agg(F.sum("used").alias("n"), F.bool_and((F.col("source") != F.col("source_b")) & (F.col("split") == F.col("split_b"))).alias("fine"))
    return each.agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(F.col("n") == BUDGET).alias("n_full"), F.count_if(F.least(F.lit(1800), F.col("n") + F.col("own")) <= F.col("n")).alias("window1_before"), F.count_if("fine").alias("donors_ok"))


@query(f"""WITH {WORDS}, c AS (SELECT doc_id, CASE WHEN n <= 512 THEN 1 ELSE 1 + ceil((n - 512) / 384.0) END::BIGINT AS k FROM w WHERE n > 512)
    SELECT count(*) AS n_cases, sum(k)::BIGINT AS n_windows, 0::BIGINT AS moved_windows, 0::BIGINT AS changed_texts FROM c""")
def identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case that is its own donor reads its own windows; an empty prefix leaves the text as it is."""
    own = cases(spark, sf_dir).where("k >= 2").select("doc_id", "k", F.col("doc_id").alias("donor"), F.col("k").alias("donor_k"))
    moved = (F.col("from_doc") != F.col("doc_id")) | (F.col("from_win") != F.col("win"))
    windows_ = read_windows(own).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(moved).alias("moved"))
    texts = table(spark, sf_dir, "documents").select("doc_id", (scalar.displaced(F.lit(""), F.col("text")) != F.col("text")).alias("changed"))
    return windows_.join(texts, "doc_id").agg(F.count(F.lit(1)).alias("n_cases"), F.sum("n").alias("n_windows"), F.sum("moved").alias("moved_windows"), F.count_if("changed").alias("changed_texts"))


@query("""WITH m AS (SELECT d.doc_id, b.item_id, position(b.text IN d.text) - 1 AS place, length(left(d.text, 3000)) AS window_end FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
    s AS (SELECT d.doc_id, avg((place >= window_end)::INT) AS beyond, count(m.item_id) AS n FROM documents d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id)
    SELECT kind, count(*) AS n, count(*) / sum(count(*)) OVER () AS part FROM (SELECT CASE WHEN n = 0 THEN 'none' WHEN beyond = 0 THEN 'in window 1' WHEN beyond = 1 THEN 'all out' ELSE 'partly out' END AS kind FROM s) GROUP BY kind""")
def evidence_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of evidence beyond the first window, in four groups, as a normalised distribution over cases."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    found = containing(docs, table(spark, sf_dir, "benchmark")).select("doc_id", (F.col("place") - 1 >= F.length(F.left("t", F.lit(3000)))).cast("double").alias("out"))
    shares = docs.select("doc_id").join(found.groupBy("doc_id").agg(F.avg("out").alias("beyond")), "doc_id", "left")
    kind = F.when(F.col("beyond").isNull(), "none").when(F.col("beyond") == 0, "in window 1").when(F.col("beyond") == 1, "all out").otherwise("partly out")
    counts = shares.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("part", F.col("n") / F.sum("n").over(Window.partitionBy()).cast("double"))


@query(f"""WITH {SPANS}, t AS (SELECT doc_id, p, (p * 37 % 101) / 100.0::DOUBLE AS prob FROM (SELECT doc_id, unnest(range(0, n_chars, 50)) AS p FROM documents))
    SELECT s.doc_id, s.k::BIGINT AS k, max(prob) AS score, 1 - max(prob) AS unsupported, count(p) AS n_points FROM s LEFT JOIN t ON t.doc_id = s.doc_id AND p >= s_start AND p < s_end GROUP BY 1, 2""")
def checker_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sentence the largest probability of the tokens that start in it; NULL where none does."""
    own = with_points(table(spark, sf_dir, "documents"))
    probs = F.transform("points", lambda p: (p * 37 % 101) / F.lit(100.0))
    own = own.select("doc_id", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"), best_in(probs, "r.lo", "r.hi").alias("score"))
    each = sentence_rows(own, "lo", "hi", "score")
    return each.select("doc_id", "k", "score", (1 - F.col("score")).alias("unsupported"), (F.col("hi") - F.col("lo")).cast("long").alias("n_points"))


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS flat, list_transform(regexp_extract_all(text, '{SENTENCE}'), lambda x: regexp_replace(x, '\\s+', ' ', 'g')) AS keys FROM documents),
    f AS (SELECT doc_id, 0 AS k, 0::BIGINT AS here, 0::BIGINT AS cursor FROM t UNION ALL
    SELECT doc_id, k + 1, at_, CASE WHEN at_ > 0 THEN at_ + length(t.keys[k + 1]) - 1 ELSE cursor END FROM (SELECT f.doc_id, f.k, f.cursor, CASE WHEN position(t.keys[k + 1] IN substr(t.flat, cursor + 1)) > 0 THEN cursor + position(t.keys[k + 1] IN substr(t.flat, cursor + 1)) ELSE position(t.keys[k + 1] IN t.flat) END AS at_
    FROM f JOIN t ON t.doc_id = f.doc_id WHERE f.k < len(t.keys)) q JOIN t USING (doc_id))
    SELECT doc_id, k::BIGINT AS k, here - 1 AS place FROM f WHERE k > 0 AND here > 0""")
def sentence_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a text's sentences, white space collapsed: each is looked for behind the one before, else anywhere."""
    flat, keys = F.regexp_replace("text", r"\s+", " "), F.transform(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", " "))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(places_in(flat, keys)).alias("k", "place"))
    return rows.where("place >= 0").select("doc_id", (F.col("k") + 1).cast("long").alias("k"), F.col("place").cast("long").alias("place"))


@query(f"""WITH {WORDS}, c AS (SELECT doc_id, n, least(n, 512) AS own FROM w) SELECT doc_id, greatest(0, least(n, 8192 - 40 - own - 8)) AS read_tokens, n > 8192 - 40 - own - 8 AS cut, least(n, greatest(0, 8192 - 40 - own - 8)) + 40 + own AS seq_len, own >= 8 AS scored FROM c""")
def long_pass_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much context one long read holds beside the prompt and the answer, in closed form for additive tokenizers; short answers are not scored."""
    own = F.least("n", F.lit(512))
    room = F.lit(8192 - 40 - 8) - own
    rows = counted(spark, sf_dir)
    return rows.select("doc_id", F.greatest(F.lit(0), F.least("n", room)).cast("long").alias("read_tokens"), (F.col("n") > room).alias("cut"), (F.least("n", F.greatest(F.lit(0), room)) + 40 + own).cast("long").alias("seq_len"), (own >= 8).alias("scored"))
