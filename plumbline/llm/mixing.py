"""Mixing sources to target weights.

The words of each source are packed into blocks of ``block`` words, its documents in a pseudorandom order. Targets per
source come from weights by water filling: no target exceeds ``repeats`` times its source's size, and what is cut off is
shared again by weight. The mix is made of output shards of ``slots`` blocks. A shard gives each source the whole part of
its share and draws the rest from a multinomial over the fractional parts. The slots of a source are numbered over all
shards; slot j reads block perm(j mod n) of pass j div n, where each pass permutes the n blocks by a swap-or-not shuffle,
so no block comes twice in a pass, and no pass beyond ``repeats`` is read. Slots and blocks meet by index.

Only DataFrame expressions; randomness is integer arithmetic, so reruns, other partitionings and other engines agree.
Running sums go in two levels (buckets of a source, rows of a bucket), so a source with a third of all rows is no single
task; the number of buckets does not change the result.

Defined results: null texts have size 0 and nothing taken; a null source is a source of its own, after all others; rows
with equal ids and sizes may trade their counts; a mix has one slot at least; a text of any length is cut where blocks begin, not held; an empty table
gives an empty result; extra columns are ignored unless passed through ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.text import let, materialise, word_array

WEIGHTS = (5, 2, 1)
SHARE, REPEATS = 1.5, 2
BLOCK, SLOTS, ROUNDS, SEED = 32, 65_536, 8, 20_011
PRIME = 2_147_483_647


def scatter(x: Column) -> Column:
    """A pseudorandom integer below PRIME for an integer of at least 0; no step leaves 64 bits."""

    def one(y: Column) -> Column:
        return ((y % PRIME) * 48_271 + 11) % PRIME

    return (((one(x) * one(x) + 69_621) % PRIME) * 16_807 + one(x) + 7) % PRIME


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, rank, weight, target) of rows (source, source_size), one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    limit = F.col("source_size") * repeats
    rising = Window.orderBy(limit.cast("double") / F.col("weight"), "rank")
    before = F.coalesce(F.sum(limit).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    level = weighed.withColumn("_level", (total * F.lit(float(share)) - before) / left)
    # the level is largest at the first source that is not cut off
    return level.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.max("_level").over(Window.partitionBy()))).drop("_level")


def shard_counts(plan: DataFrame, block: int, slots: int, seed: int) -> DataFrame:
    """(rank, n_blocks, shard, first, n): how many slots each shard gives a source, and the source's first slot number there."""
    total = F.sum("target").over(Window.partitionBy()) / block
    whole = F.floor(total / slots)
    shared = plan.withColumns({"_p": F.col("target") / block / total, "_whole": whole, "_rest": F.greatest(F.round(total - whole * slots), F.when(whole == 0, 1).otherwise(0)).cast("long")}).where("target > 0")
    dealt = shared.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_whole")))).withColumn("_k", F.when(F.col("shard") < F.col("_whole"), F.lit(slots).cast("long")).otherwise(F.col("_rest")))
    exact = F.col("_k") * F.col("_p")
    parts = dealt.withColumns({"_base": F.floor(exact), "_part": exact - F.floor(exact)})
    of_shard = Window.partitionBy("shard")
    run = of_shard.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    drawn = parts.withColumns({
        "_draws": F.col("_k") - F.sum("_base").over(of_shard),
        "_hi": F.sum("_part").over(run),
        "_sum": F.sum("_part").over(of_shard),
        "_last": F.max("rank").over(of_shard),
    })
    u = lambda r: scatter(F.col("shard") * 7919 + seed) + r * 104_729
    mixed = drawn.withColumn("_u", F.when(F.col("_draws") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("_draws") - 1), u)).otherwise(F.array().cast("array<bigint>")))
    flat = mixed.withColumn("_v", F.transform("_u", lambda x: scatter(x).cast("double") / PRIME * F.col("_sum")))
    mine = F.filter("_v", lambda v: (v >= F.col("_hi") - F.col("_part")) & ((v < F.col("_hi")) | (F.col("rank") == F.col("_last"))))
    counted = flat.withColumn("n", F.col("_base") + F.size(mine))
    back = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("rank", "n_blocks", "shard", F.coalesce(F.sum("n").over(back), F.lit(0)).alias("first"), "n")


def block_slots(counts: DataFrame, repeats: int, rounds: int, seed: int, chunk: int = 1024) -> DataFrame:
    """(rank, block, pass, shard, slot): the blocks that the slots of each shard read."""
    pieces = counts.where("n > 0").withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long"))))
    # a few rows stand for all slots: deal them out before they grow, to a stated number of tasks, which no measured size shrinks
    pieces = pieces.repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("shard"), F.col("rank"), F.col("_c"))
    slots = pieces.withColumn("slot", F.explode(F.sequence(F.col("_c"), F.least(F.col("_c") + chunk, F.col("n")) - 1)))
    slots = slots.withColumn("_j", F.col("first") + F.col("slot")).withColumns({"pass": F.floor(F.col("_j") / F.col("n_blocks")), "x": F.col("_j") % F.col("n_blocks")})
    slots = slots.where(F.col("pass") < repeats).select("rank", "n_blocks", "pass", "shard", "slot", "x")
    key = F.col("rank") * 1_000_003 + F.col("pass") * 10_007 + seed

    for r in range(rounds):  # plain columns, so that a round is compiled code
        slots = slots.withColumn("_y", (F.pmod(scatter(key + r * 7919), F.col("n_blocks")) + F.col("n_blocks") - F.col("x")) % F.col("n_blocks"))
        slots = slots.withColumn("_m", F.greatest("x", "_y") + F.col("rank") * 331 + F.col("pass") * 17 + (r * 60_013 + seed))
        slots = slots.withColumn("x", F.when(F.shiftright(scatter(F.col("_m")), 13) % 2 == 1, F.col("_y")).otherwise(F.col("x")))
    return slots.select("rank", F.col("x").alias("block"), "pass", "shard", "slot")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken, and ``ranges``, an array of (pass, begin, end), the word ranges the mix reads."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(word_array(F.col(text))).cast("long").alias("size"), *[F.col(k).alias(f"keep_{k}") for k in keep])
    rows = materialise(keyed.withColumn("u", scatter(F.coalesce(F.col("doc_id"), F.lit(0)) % 1_000_000_007 + 1_000_000_007)))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats)
    plan = materialise(plan.withColumn("n_blocks", F.ceil(F.col("source_size") / block)))

    per = max(1, PRIME // (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = rows.join(plan.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_").withColumn("bucket", F.floor(F.col("u") / per))
    sums = placed.groupBy("rank", "bucket").agg(F.sum("size").alias("_n"))
    offsets = sums.select("rank", "bucket", (F.sum("_n").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("_n")).alias("_offset"))
    inner = Window.partitionBy("rank", "bucket").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    packed = placed.withColumn("_run", F.sum("size").over(inner)).join(offsets, ["rank", "bucket"])
    packed = packed.withColumn("start", F.col("_offset") + F.col("_run") - F.col("size")).drop("_run", "_offset", "u", "bucket")

    pieces = packed.where("size > 0").select("rank", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    # written once: a filter inferred from the join would be copied through every round, and the rows before the slots tell nothing of their size
    read = materialise(block_slots(shard_counts(plan, block, slots, seed), repeats, ROUNDS, seed).select("rank", "block", "pass"))
    taken = pieces.join(read, ["rank", "block"]).select(
        "rank", "start", "pass",
        (F.greatest(F.col("start"), F.col("block") * block) - F.col("start")).alias("begin"),
        (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("start")).alias("end"),
    )
    ranges = taken.groupBy("rank", "start").agg(F.sort_array(F.collect_list(F.struct("pass", "begin", "end"))).alias("ranges"))
    some = packed.where("size > 0").join(ranges, ["rank", "start"], "left")
    none = packed.where("size = 0").withColumn("ranges", F.lit(None).cast(ranges.schema["ranges"].dataType))
    result = some.unionByName(none)
    total = F.aggregate(F.coalesce("ranges", F.expr("array()").cast(ranges.schema["ranges"].dataType)), F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["begin"])
    return result.select("doc_id", "size", "source", "source_size", "target", total.alias("taken"), *[F.col(f"keep_{k}").alias(k) for k in keep], "ranges")


def mixed_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = (), **options) -> DataFrame:
    """The mix itself: per document and pass that reads from it, doc_id, source, the ``keep`` columns and ``text``, the words read with the blanks that follow them.

    The plan is made without texts; these move once, to meet their ranges by two hashes of id, source and text.
    """
    own = [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")]
    keys = [F.xxhash64(F.lit(i), doc_id, source, text).alias(f"k{i}") for i in (1, 2)]
    order = Window.partitionBy("k1", "k2")
    plan = mix_sources(docs.select(*own, *keys), keep=("k1", "k2"), **options).where("taken > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), "ranges")
    plan = plan.withColumn("m", F.row_number().over(Window.partitionBy("p1", "p2").orderBy("ranges")))
    rows = docs.select(*own, *keys, *[F.col(k).alias(f"keep_{k}") for k in keep]).withColumn("n", F.row_number().over(order.orderBy(F.lit(1))))
    # the numbers of repeated rows meet as a remainder, so that both sides stay dealt by the two hashes
    whole = rows.join(plan, (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")) & (F.col("n") - F.col("m") == 0))

    def read(pieces: Column) -> Column:
        of_pass = lambda p: F.array_join(F.flatten(F.transform(F.filter("ranges", lambda r: r["pass"] == p), lambda r: F.slice(pieces, (r["begin"] + 1).cast("int"), (r["end"] - r["begin"]).cast("int")))), "")
        return F.transform(F.array_distinct(F.transform("ranges", lambda r: r["pass"])), of_pass)

    texts = let(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), read)
    return whole.withColumn("text", F.explode(texts)).select("doc_id", "source", *[F.col(f"keep_{k}").alias(k) for k in keep], "text")
