"""Line deduplication by a log-template tree of fixed depth.

A line's words are masked where they hold a digit; a line of fewer than ``depth`` words has no place for a field and is
taken as it is. The tree has one level for the number of words and ``depth`` levels
for the leading masked words; a path of these is a leaf. In a leaf that lines of ``least`` different texts reach, a word
at a later place is constant if it stands there in that many, else it becomes a variable field. If the constants make up
``share`` of the words, and one stands behind the leading words or all words there are masked, that is the line's
template; otherwise the line as it is, digits included, is. Templates found in ``least``
different texts recur, and so does the very same line of ``long`` words or more in ``twice`` different texts. Their lines
are dropped from all documents but the one with the smallest id, so that a group of near copies leaves one whole document.

Only DataFrame expressions. Leaves are counted on hashes; only lines of busy leaves carry their words any further, and
the text moves once, to meet its dropped lines.

Defined results: lines are split at ``\\n`` and keep their order and blanks; lines of fewer than ``shortest`` words are
never dropped, by default only blank ones; a null text stays null with no lines; equal texts count once, whatever their ids; of rows with null ids
none is the first unless all are; repeated rows lose the same lines;
lines and texts of any length count whole; an empty table gives no rows; extra columns are ignored unless passed through
``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import let, materialise, word_array

DEPTH, LEAST, SHARE, SHORTEST = 3, 10, 0.7, 1
LONG, TWICE = 10, 2
FIELD = "<*>"


def _single_blanks(line: Column) -> Column:
    """The line's words joined by single blanks; most lines are that already, and need no splitting."""
    odd = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for blank in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(blank))
    return F.when(odd, F.array_join(word_array(line), " ")).otherwise(line)


def _n_words(joined: Column) -> Column:
    return F.when(joined == "", 0).otherwise(F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(" "), F.lit(""))) + 1)


def _long_lines(rows: DataFrame, long: int) -> DataFrame:
    """(doc_id, h, pos, line) of the long lines, line as a hash of its words; narrow, as these may be most lines of a corpus."""
    each = F.transform(F.split("text", "\n"), lambda x: let(_single_blanks(x), lambda j: F.when(_n_words(j) >= long, F.xxhash64(j))))
    return rows.select("doc_id", "h", F.posexplode(each).alias("pos", "line")).where(F.col("line").isNotNull())


def _fields(line: Column, depth: int) -> Column:
    """(masked, n, leaf) of a line. One expression inside the array of lines, so that each part is computed once."""

    def of_joined(joined: Column) -> Column:
        return let(_n_words(joined), lambda k: of_counted(joined, k))

    def of_counted(joined: Column, k: Column) -> Column:
        masked = F.when((k >= depth) & joined.rlike("[0-9]"), F.regexp_replace(joined, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(joined)
        return let(masked, lambda m: F.struct(m.alias("masked"), F.when(m != joined, F.xxhash64(joined)).alias("raw"), k.alias("n"), F.xxhash64(k, F.substring_index(m, " ", depth)).alias("leaf")))

    return let(_single_blanks(line), of_joined)


def _lines(rows: DataFrame, depth: int) -> DataFrame:
    """(doc_id, h, pos, masked, raw, n, leaf) per line; raw is a hash of a line that was masked. A leaf is the number of words with the leading words."""
    each = rows.select("doc_id", "h", F.posexplode(F.transform(F.split("text", "\n"), lambda x: _fields(x, depth))).alias("pos", "line"))
    return each.select("doc_id", "h", "pos", "line.masked", "line.raw", "line.n", "line.leaf")


def drop_templates(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, share: float = SHARE, shortest: int = SHORTEST, long: int = LONG, twice: int = TWICE, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, the ``keep`` columns, n_lines, n_dropped and text (the remaining lines)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(k).alias(f"keep_{k}") for k in keep]).withColumn("h", F.xxhash64("text"))
    lines = _lines(rows, depth).where(F.col("n") >= shortest)
    busy = materialise(lines.groupBy("leaf", "h").agg(F.lit(1).alias("_")).groupBy("leaf").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).select("leaf"))
    here = materialise(lines.join(busy, "leaf").select("leaf", F.xxhash64("masked").alias("key"), "masked", "raw", "doc_id", "h", "pos"))

    texts = here.groupBy("leaf", "key", "h").agg(F.min("masked").alias("masked"))
    kinds = materialise(texts.groupBy("leaf", "key").agg(F.min("masked").alias("masked"), F.count(F.lit(1)).alias("c")))
    words = kinds.select("leaf", "key", "c", F.posexplode(F.split("masked", " ")).alias("at", "word"))
    later = words.where(F.col("at") >= depth)
    often = later.groupBy("leaf", "at", "word").agg(F.sum("c").alias("s")).where(F.col("s") >= least).select("leaf", "at", "word", F.lit(True).alias("fixed"))
    told = later.join(often, ["leaf", "at", "word"], "left").select("leaf", "key", "at", F.when(F.col("fixed") & (F.col("word") != FIELD), F.col("word")).alias("word"))
    shapes = told.groupBy("leaf", "key").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("word", F.lit(FIELD)).alias("word")))).alias("shape"), F.count("word").alias("fixed"))
    size = F.size(F.split("masked", " "))
    lead = F.size(F.filter(F.slice(F.split("masked", " "), 1, depth), lambda w: w != FIELD))
    enough = F.coalesce("fixed", F.lit(0)) + lead >= F.lit(share) * size
    behind = (F.coalesce("fixed", F.lit(0)) > 0) | F.forall(F.slice(F.split("masked", " "), depth + 1, size), lambda w: w == FIELD)
    template = F.when(enough & behind & F.col("shape").isNotNull(), F.xxhash64("leaf", F.col("shape.word")))  # null: the line as it is
    named = materialise(kinds.join(shapes, ["leaf", "key"], "left").select("leaf", "key", template.alias("template")))

    # the line as it is: its raw hash where it was masked, else its key
    exactly = F.coalesce("template", F.xxhash64("leaf", F.coalesce("raw", "key"))).alias("template")
    found = here.join(named, ["leaf", "key"]).select(exactly, "doc_id", "h", "pos")
    met = found.groupBy("template", "h").agg(F.min("doc_id").alias("doc_id"))
    recurring = met.groupBy("template").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("first")).where(F.col("c") >= least)
    gone = found.join(materialise(recurring.select("template", "first")), "template").where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "h", "pos")

    exact = _long_lines(rows, long)
    again = exact.groupBy("line", "h").agg(F.min("doc_id").alias("doc_id")).groupBy("line").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("first")).where(F.col("c") >= twice)
    copies = exact.join(materialise(again.select("line", "first")), "line").where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "h", "pos")
    gone = gone.union(copies).groupBy("doc_id", "h").agg(F.collect_set("pos").alias("gone"))

    marked = rows.join(gone.withColumnsRenamed({"doc_id": "d_", "h": "h_"}), F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("h") == F.col("h_")), "left")
    split = F.split("text", "\n")

    def left(all_lines: Column) -> Column:
        order = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone"))
        return F.array_join(F.transform(order, lambda i: F.get(all_lines, i)), "\n")

    return marked.select(
        "doc_id", *[F.col(f"keep_{k}").alias(k) for k in keep],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(split, left)).alias("text"),
    )
