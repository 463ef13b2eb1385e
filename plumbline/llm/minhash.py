"""MinHash near-duplicates with min-max hashing and exact confirmation.

Each of ``permutations`` hash functions yields two signature values, its minimum and its maximum over the set, so a
signature of 160 values takes 80 hash evaluations. Values are banded; documents that share a band are candidates, and
every link is confirmed on the full shingle sets. Equal sets collapse to one class first, so exact copies cost one row.

Candidates never become all pairs of a bucket. Each bucket links its members to one leader, the member that meets the
most others; after confirmation, buckets that lie inside one component are done, since more links change nothing. Only
buckets that still hold several components go on: to another leader, and then to a test of all their members in blocks;
buckets that share members are tested together while they are few. A task compares two blocks by matrix products and returns a forest of
links, so no link between different components is lost and no list of pairs is ever made. A leader's set is sent once to
each block of its members, so a leader that a third of all documents meet is no single task.

With 32 bands of 5 values a pair of similarity 0.8 shares no band with a probability of 3 in a million.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; a text of one word has its
word as only shingle; rows that repeat an id belong together; a row with a null id has its set size, no component, and is
not kept; very long texts are read whole, a few megabytes of texts at a time; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.hashing import mix, shingle_sets
from plumbline.llm.text import discard, materialise

BANDS, ROWS, SEED = 32, 5, 7
PIECE = 1 << 20
#: Blocks of members up to which buckets that share members are tested together.
FEW = 4


def _pieces(ids: list, texts: list) -> Iterator[tuple[list, list]]:
    """Runs of rows of about a megabyte, so that memory stays small whatever the texts' lengths."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= PIECE:
            yield ids[start : i + 1], texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(ids):
        yield ids[start:], texts[start:]


def signatures(sets: list[np.ndarray], bands: int, rows: int, seed: int = SEED) -> np.ndarray:
    """Band keys of non-empty sets, an array (sets, bands) of int64."""
    n = (bands * rows + 1) // 2
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    at = np.cumsum(sizes) - sizes
    values = np.empty((2 * n, len(sets)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            x = ((flat * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32)
            values[2 * k] = np.minimum.reduceat(x, at)
            values[2 * k + 1] = np.maximum.reduceat(x, at)
        # a band takes values of different permutations where it can: minima and maxima are dealt round
        order = np.concatenate([np.arange(0, 2 * n, 2), np.arange(1, 2 * n, 2)])[: bands * rows]
        keys = np.zeros((bands, len(sets)), np.uint64)
        for r in range(rows):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[order[r * bands : (r + 1) * bands]])
        keys = mix(keys + np.arange(bands, dtype=np.uint64)[:, None])
    return keys.T.view(np.int64)


def set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits per set, an array (sets, 2) of int64: equal sets agree, others do not at any size of corpus."""
    out = np.zeros((len(sets), 2), np.uint64)
    with np.errstate(over="ignore"):
        for i, s in enumerate(sets):
            n = np.uint64(len(s))
            out[i] = mix(s + n).sum(dtype=np.uint64), mix(mix(s) ^ (n + np.uint64(1))).sum(dtype=np.uint64)
        return mix(out).view(np.int64)


def sketch(docs: DataFrame, width: int, bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, bands) per row; bands is empty for empty sets."""
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sets = shingle_sets(texts, width)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [[]] * len(sets)
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full], bands, rows), strict=True):
                        keys[i] = row
                h = set_hashes(sets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "h1", "h2", "bands"],
                )

    return source.mapInArrow(run, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(class_id, h1, shingles) of rows (class_id, h1, h2, t): the texts that have those hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h1, h2, texts = (c.to_pylist() for c in batch.columns)
            for some, own in _pieces(list(zip(ids, h1, h2, strict=True)), texts):
                sets = shingle_sets(own, width)
                found = [(i, a, s.view(np.int64)) for (i, a, b), s, h in zip(some, sets, set_hashes(sets).tolist(), strict=True) if [a, b] == h]  # an id may come with several texts
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in found], pa.int64()), pa.array([a for _, a, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.list_(pa.int64()))], names=["class_id", "h1", "shingles"])

    return docs.mapInArrow(run, "class_id bigint, h1 bigint, shingles array<bigint>")


def _can_link(x: Column, y: Column, percent: int) -> Column:
    """Sizes that allow the similarity at all."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b, part) whose full sets are similar enough. Members b bring their sets; leaders a send theirs to each part of their members once."""
    members = pairs.join(sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("y")), "b")
    leaders = pairs.select("a", "part").distinct().join(sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("x")), "a")
    shared = members.join(leaders, ["a", "part"]).select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("k"))
    return shared.where(100 * F.col("k") >= percent * (F.col("m") + F.col("n") - F.col("k"))).select("a", "b").distinct()


def _leader_pairs(now: DataFrame, percent: int, step: int, block: int) -> DataFrame:
    """(a, b, part): per open bucket its leader a with each member b of another component. ``now``: (key, class_id, n, order, component)."""
    top = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("c"), F.max(F.struct("order", "class_id", "n", "component")).alias("top")).where("lo < hi")
    if step:  # another leader: any member outside the first leader's component
        rest = now.join(top.select("key", "c", F.col("top.component").alias("not")), "key").where(F.col("component") != F.col("not"))
        top = rest.groupBy("key").agg(F.max("c").alias("c"), F.max(F.struct(F.xxhash64("class_id", F.lit(step)).alias("draw"), "class_id", "n", "component")).alias("top"))
    met = now.join(top.select("key", "c", F.col("top.class_id").alias("a"), F.col("top.n").alias("m"), F.col("top.component").alias("of")), "key")
    met = met.where((F.col("component") != F.col("of")) & _can_link(F.col("m"), F.col("n"), percent))
    part = F.pmod(F.xxhash64("class_id"), F.ceil(F.col("c") / block))
    # a pair that several buckets hold is tested once
    once = met.groupBy(F.least("a", "class_id").alias("lo"), F.greatest("a", "class_id").alias("hi")).agg(F.max(F.struct("a", F.col("class_id").alias("b"), part.alias("part"))).alias("p"))
    return once.select("lo", "hi", "p.a", "p.b", "p.part")


def block_links(ids: tuple, sizes: tuple, parts: tuple, sets: tuple, percent: int, same: bool) -> list[tuple[int, int]]:
    """Links between the documents of two blocks (``same``: one block twice) that join different components, as a forest. Each argument holds both sides."""
    flat = [np.concatenate(x) for x in sets]
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in sets]
    order = [np.argsort(x, kind="stable") for x in flat]
    flat, owner = [x[o] for x, o in zip(flat, order, strict=True)], [x[o] for x, o in zip(owner, order, strict=True)]
    both = np.intersect1d(flat[0], flat[1])
    shared = np.zeros((len(ids[0]), len(ids[1])), np.float32)
    for at in range(0, len(both), 4096):  # a few thousand shingles at a time, so that memory has a bound
        some = both[at : at + 4096]
        hold = []
        for x, own in zip(flat, owner, strict=True):
            a, b = np.searchsorted(x, some[0], "left"), np.searchsorted(x, some[-1], "right")
            place = np.searchsorted(some, x[a:b])
            hit = some[place] == x[a:b]
            dense = np.zeros((own.max() + 1 if len(own) else 0, len(some)), np.float32)
            dense[own[a:b][hit], place[hit]] = 1
            hold.append(dense)
        shared += hold[0] @ hold[1].T
    linked = 100 * shared >= percent * (sizes[0][:, None] + sizes[1][None, :] - shared)
    linked &= parts[0][:, None] != parts[1][None, :]
    if same:
        linked = np.triu(linked, 1)
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.get(x, x) != x:
            x = above[x] = above.get(above[x], above[x])
        return x

    links = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = root(int(parts[0][i])), root(int(parts[1][j]))
        if a != b:
            above[max(a, b)] = min(a, b)
            links.append((int(ids[0][i]), int(ids[1][j])))
    return links


def _units(now: DataFrame, block: int) -> DataFrame:
    """(key, blocks, class_id, component): the members of open buckets, dealt so that the members of each bucket meet.

    Buckets that share members mostly hold the same ones. Together they are a group; a group of a few blocks is one unit,
    so each of its members comes once. In larger groups, which buckets may chain without end, each bucket is a unit.
    """
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), "class_id").cast("decimal(38,0)")).alias(f"m{seed}")
    open_ = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("c"), F.min("class_id").alias("least"), mark(1), mark(2)).where("lo < hi")
    open_ = open_.groupBy("c", "m1", "m2").agg(F.min("key").alias("key"), F.min("least").alias("least")).select("key", "c", "least")
    members = materialise(now.join(open_, "key").select("key", "c", "least", "class_id", "component").distinct())
    groups = components(members.select(F.col("class_id").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("class_id"), F.col("component").alias("group"))
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    placed = members.join(groups, "class_id").join(sizes, "group")
    few = F.col("size") <= FEW * block
    n = F.when(few, F.col("size")).otherwise(F.col("c"))
    unit = F.struct(few.alias("few"), F.when(few, F.col("group")).otherwise(F.col("key")).alias("of"))
    return placed.select(unit.alias("key"), F.ceil(n / block).cast("int").alias("blocks"), "class_id", "component").distinct()


def _cross_links(now: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) between different components of an open bucket: every pair is tested, in blocks of members, and only a forest comes out."""
    members = materialise(_units(now, block))
    dealt = members.withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    rows = dealt.join(sets, "class_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class_id", "h1", "component", "shingles")

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["class_id", "h1"])
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        sides = [pdf[pdf["own"] == k] for k in (i, j)]
        links = []
        if len(sides[0]) and len(sides[1]) and pdf["component"].nunique() > 1:
            held = [list(x["shingles"]) for x in sides]
            links = block_links(tuple(x["class_id"].to_numpy() for x in sides), tuple(np.array([len(s) for s in x]) for x in held), tuple(x["component"].to_numpy() for x in sides), tuple(held), percent, i == j)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return rows.groupBy("key", "i", "j").applyInPandas(test, "a bigint, b bigint")


def _same_id(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of an id that comes with several texts."""
    several = full.groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("doc_id")
    held = full.join(several, "doc_id").select("doc_id", "h1", "h2").distinct().join(classes.select("h1", "h2", "class_id"), ["h1", "h2"])
    least = held.withColumn("b", F.min("class_id").over(Window.partitionBy("doc_id")))
    return least.where("class_id <> b").select(F.col("class_id").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, leaders: int = 2, block: int = 256, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over confirmed links) and kept."""
    sig = materialise(sketch(docs, width, bands, rows, doc_id, text))
    full = sig.where("n_shingles > 0 and doc_id is not null")
    # a class is named by its smallest id, so the least class of a component is its smallest id too
    classes = materialise(full.groupBy("h1", "h2").agg(F.min("n_shingles").alias("n"), F.min("doc_id").alias("class_id"), F.min_by("bands", "doc_id").alias("bands")))

    placed = classes.select("class_id", "n", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = materialise(placed.join(shared, "key"))  # only buckets of several classes
    degree = met.groupBy("class_id").agg(F.sum("c").alias("degree"))
    met2 = materialise(met.select("key", "class_id", "n").join(degree, "class_id").withColumn("order", F.struct(F.col("degree"), F.col("class_id"))))

    wanted = met.select("class_id").distinct().join(classes.select("class_id", "h1", "h2"), "class_id").withColumn("doc_id", F.col("class_id")).hint("shuffle_hash")
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("t")).join(wanted, "doc_id").select("class_id", "h1", "h2", "t")
    sets = materialise(_sets(texts, width))
    discard(met)

    links = materialise(_same_id(full, classes))
    label = components(links).select(F.col("node").alias("class_id"), "component")
    tested = None
    for step in range(leaders + 1):
        now = met2.join(label.withColumnRenamed("class_id", "c_"), F.col("class_id") == F.col("c_"), "left").select("key", "class_id", "n", "order", F.coalesce("component", "class_id").alias("component"))
        if step < leaders:
            pairs = _leader_pairs(now, percent, step, block)
            pairs = materialise(pairs if tested is None else pairs.join(tested, ["lo", "hi"], "left_anti"))
            tested = pairs.select("lo", "hi") if tested is None else tested.union(pairs.select("lo", "hi"))
            new = materialise(_confirmed(pairs.select("a", "b", "part"), sets, percent))
        else:
            new = materialise(_cross_links(now, sets, percent, block))
        if not new.isEmpty():
            links = links.union(new)
            label = components(links).select(F.col("node").alias("class_id"), "component")

    of_class = classes.select("h1", "h2", "class_id").join(label.withColumnRenamed("class_id", "c_"), F.col("class_id") == F.col("c_"), "left").select("h1", "h2", F.coalesce("component", "class_id").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    found = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", found.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
