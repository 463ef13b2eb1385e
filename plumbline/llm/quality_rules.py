"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Two multinomials over ``buckets`` hashed unigrams and bigrams are counted, one over the trusted documents and one over
all documents. A document's score is the mean log ratio of its n-grams, and a fixed threshold decides. Base rules on
length and repetition come first. Everything is a DataFrame expression; the text moves once, to meet its label, and
the ratios reach the scoring scan as one array of ``buckets`` doubles.

Defined results: a null or blank text has no words, fails the base rules and is not kept; a document without n-grams
scores 0; repeated rows each get their own row; a null quality is not trusted; labels that repeat count once; with no
trusted documents both multinomials are the smoothed uniform and raw ones, and the threshold still decides; a
text of any length is read whole; an empty table gives no rows; extra columns are ignored unless passed through ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import let, word_array

BUCKETS = 10_000
SMOOTHING = 1.0
#: Mean log ratio below which a document is dropped. Documents of the trusted kind score about zero.
THRESHOLD = -0.1
SYMBOLS = "[#*$%&|<>]"


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _grams(h: Column, buckets: int) -> Column:
    """Buckets of all words, then of all pairs of adjacent words. ``h``: the words' hashes, a lambda's variable."""
    one = F.transform(h, lambda a: F.pmod(a, F.lit(buckets)).cast("int"))
    two = F.zip_with(F.slice(h, F.lit(1), F.size(h) - 1), F.slice(h, F.lit(2), F.size(h) - 1), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))
    return F.when(F.size(h) > 1, F.concat(one, two)).otherwise(one)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row, one array column ``ratios`` of length ``buckets``. ``trusted`` holds ids of the target documents."""
    flags = trusted.select(F.col(doc_id).alias("_id")).where("_id is not null").distinct().withColumn("_t", F.lit(1))
    both = docs.select(F.col(doc_id).alias("_id"), text).join(flags.hint("shuffle_hash"), "_id", "left")
    grams = both.select("_t", F.explode(let(_hashes(word_array(F.col(text))), lambda h: _grams(h, buckets))).alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("n_raw"), F.count("_t").alias("n_target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    full = every.join(counts, "b", "left").na.fill(0, ["n_raw", "n_target"])
    sums = full.agg(
        F.sort_array(F.collect_list(F.struct("b", "n_target", "n_raw"))).alias("c"),
        F.sum("n_target").alias("t"),
        F.sum("n_raw").alias("r"),
    )
    mass = smoothing * buckets
    return sums.select(
        F.transform("c", lambda x: F.log((x["n_target"] + F.lit(smoothing)) / (F.col("t") + F.lit(mass))) - F.log((x["n_raw"] + F.lit(smoothing)) / (F.col("r") + F.lit(mass)))).alias("ratios")
    )


def _repeated(h: Column) -> Column:
    """Words inside 5-word windows that occur at least twice in the text. ``h``: the words' hashes, a lambda's variable."""

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = let(placed, lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])))
        places = F.sort_array(F.transform(twice, lambda x: x["p"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + p + 5 - F.greatest(a["end"], p)).alias("n"), (p + 5).alias("end")), lambda a: a["n"])

    windows = F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))
    some = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))
    return F.when(F.size(h) < 5, F.lit(0)).otherwise(some)


def quality_rules(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, smoothing: float = SMOOTHING, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: the counts of the base rules, ``llr`` (mean log ratio), ``base_failed`` and ``kept``."""
    ratios = log_ratios(docs, trusted, buckets, smoothing, doc_id, text).scalar()
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    zero = F.lit(0.0)
    mean = lambda g: F.aggregate(g, zero, lambda a, b: a + F.get(F.col("_ratios"), b), lambda a: F.when(F.size(g) == 0, zero).otherwise(a / F.size(g)))

    def of_hashes(h: Column) -> Column:
        return F.struct(_repeated(h).alias("repeated"), let(_grams(h, buckets), mean).alias("llr"))

    measured = docs.withColumn("_ratios", ratios).select(
        F.col(doc_id).alias("doc_id"),
        *keep,
        let(word_array(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("chars"), let(_hashes(w), of_hashes).alias("of"))).alias("_m"),
        F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    counted = measured.select(
        "doc_id", *keep, F.col("_m.n").cast("long").alias("n_words"), F.col("_m.chars").cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines", F.col("_m.of.repeated").cast("long").alias("n_repeat_words"), F.col("_m.of.llr").alias("llr"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select(
        "doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr",
    )
