"""Approximate nearest neighbours by low-dimensional 2-stable projections and kd-trees.

All vectors are projected to ``dims`` Gaussian coordinates. The upper levels of one kd-tree, median splits of a bounded
sample, cut the projected space into cells; the lower levels are one kd-tree per shard, a cell or, where a cell holds more
rows than a shard should, an equal part of it. Every row is indexed.

A query takes projected neighbours in rising projected distance and verifies each on the original vectors. With d the
distance of its k-th best so far, an unseen vector within d has a projected distance below that of all that follow, r,
with chi-square probability Psi(r^2 / d^2) at least; the search stops once that reaches ``confidence``. There is no other
stop. It begins in the query's own cell. The d it finds there tells by the same test which other cells can be left out by
their boxes; it goes on in all others.

A shard is read by one task, which builds its tree once and then lets its queries stream past, so memory is that of a
shard. Results are merged per query, k rows of each shard it met. Equal vectors share one entry: only as many of their
rows as can be returned are kept, before they are shuffled, so a third of all rows may be copies of one vector.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, neither as query nor as candidate; ties go to the smaller id; with fewer than k candidates all are returned;
a null id takes no part; repeated rows are separate candidates with equal ids, of which the query's own id is never one; a
query id that comes several times is asked once, for the vector of the smallest hash; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.text import materialise, one_thread

DIMS, CONFIDENCE, LEAF, SEED = 8, 0.98, 48, 5
SHARD_ROWS, SAMPLE, PER_CELL = 10_000, 200_000, 16


def chi_square(x: float, dims: int) -> float:
    """The chi-square distribution for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, dims // 2):
        term *= half / i
        total += term
    return 1.0 - math.exp(-half) * total if half < 700 else 1.0


class Tree:
    """A kd-tree over projected points: median splits of the widest coordinate, leaves of ``leaf`` points, boxes per node."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.order = np.arange(len(points))
        self.low, self.high, self.kids, self.span = [], [], [], []
        if len(points):
            self._build(0, len(points))

    def _build(self, a: int, b: int) -> int:
        at = len(self.span)
        own = self.points[self.order[a:b]]
        lo, hi = own.min(0), own.max(0)
        self.low.append(lo)
        self.high.append(hi)
        self.kids.append(None)
        self.span.append((a, b))
        if b - a > self.leaf and (hi > lo).any():
            axis, half = int((hi - lo).argmax()), (b - a) // 2
            part = np.argpartition(own[:, axis], half)
            self.order[a:b] = self.order[a:b][part]
            self.kids[at] = (self._build(a, a + half), self._build(a + half, b))
        return at

    def nearest(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Groups of points with a lower bound of the squared projected distance of all that follow them, the group included."""

        def bound(n: int) -> float:
            gap = np.maximum(np.maximum(self.low[n] - q, q - self.high[n]), 0)
            return float(gap @ gap)

        heap = [(bound(0), 0)] if self.span else []
        while heap:
            d, n = heapq.heappop(heap)
            if self.kids[n] is None:
                a, b = self.span[n]
                yield d, self.order[a:b]
            else:
                for k in self.kids[n]:
                    heapq.heappush(heap, (bound(k), k))


class Shard:
    """The index of one shard's rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, plane: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(1)
        first = np.flatnonzero(new)
        self.vectors, self.k = vectors[first], k
        ends = np.append(first[1:], len(ids))
        # k + 1 distinct ids can be returned for a vector, and repeated rows of the query's own id never are
        self.ids = [ids[a:b] for a, b in zip(first, ends, strict=True)]
        self.plane, self.dims = plane, plane.shape[1]
        self.tree = Tree(self.vectors @ plane)

    def search(self, own: int, q: np.ndarray, confidence: float = CONFIDENCE, reach: float = math.inf) -> list[tuple[float, int]]:
        """The k nearest (distance, id), or those of them within ``reach``, at which k others are known already."""
        best: list[tuple[float, int]] = []
        for bound, group in self.tree.nearest(q @ self.plane):
            far = min(reach, best[-1][0]) if len(best) == self.k else reach
            # strictly above: equal projected distances may be equal distances, which smaller ids win
            if far < math.inf and bound > 0 and (far == 0 or chi_square(bound / far**2, self.dims) >= confidence):
                break
            gap = self.vectors[group] - q
            dist = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            limit = far
            more = [(float(dist[i]), int(x)) for i in np.flatnonzero(dist <= limit) for x in self.ids[group[i]][: self.k + int((self.ids[group[i]] == own).sum())] if x != own]
            if more:
                best = heapq.nsmallest(self.k, best + more)
        return best


def plane_of(length: int, dims: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((length, dims))


class Cells:
    """The upper levels of the kd-tree: ``n`` cells by median splits of the widest coordinate of a sample of projected points."""

    def __init__(self, points: np.ndarray, n: int):
        self.axis, self.cut, self.kids, self.n = [], [], [], 0
        self._build(points, n)

    def _build(self, points: np.ndarray, n: int) -> int:
        spread = points.max(0) - points.min(0) if n > 1 and len(points) > 1 else np.zeros(1)
        if not (spread > 0).any():
            self.n += 1
            return -self.n
        at, axis = len(self.axis), int(spread.argmax())
        cut = float(np.median(points[:, axis]))
        left = points[:, axis] < cut
        if not left.any():  # the median is the least value
            cut = float(points[~(points[:, axis] <= cut), axis].min())
            left = points[:, axis] < cut
        self.axis.append(axis)
        self.cut.append(cut)
        self.kids.append(None)
        self.kids[at] = (self._build(points[left], n // 2), self._build(points[~left], n - n // 2))
        return at

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell, from 0, of each point."""
        out = np.zeros(len(points), np.int32)
        open_ = [(0, np.arange(len(points)))] if self.axis else []
        while open_:
            node, rows = open_.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                left = points[rows, self.axis[node]] < self.cut[node]
                open_ += [(self.kids[node][0], rows[left]), (self.kids[node][1], rows[~left])]
        return out


def sound(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _few_copies(base: DataFrame, k: int) -> DataFrame:
    """The rows of equal vectors that can be returned: those of the smallest ids. Each task drops the others before the shuffle."""
    most = base.groupBy("vec_id").count().agg(F.max("count")).first()[0]
    keyed = base.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    first = lambda df, n, *keys: df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("r") <= n).drop("r")
    if most > 1:  # of the query's own id any number may come; k others are wanted
        return first(first(keyed, k, "h1", "h2", "vec_id"), 2 * k, "h1", "h2").drop("h1", "h2")
    return first(keyed, k + 1, "h1", "h2").drop("h1", "h2")


def _in_cells(df: DataFrame, cells: Cells, plane: np.ndarray) -> DataFrame:
    """Adds ``cell`` and the projection ``p`` to rows (vec_id, v)."""
    sent = df.sparkSession.sparkContext.broadcast((cells, plane))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, flat = sent.value
        for batch in batches:
            if batch.num_rows:
                points = _matrix(batch.column(1)) @ flat
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.of(points)), pa.array(list(points), pa.list_(pa.float64()))], names=["vec_id", "v", "cell", "p"])

    return df.mapInArrow(run, f"{fields}, cell int, p array<double>")


def _searched(base: DataFrame, asked: DataFrame, plane: np.ndarray, k: int, confidence: float, shards: int) -> DataFrame:
    """(query_id, vec_id, score) of rows (shard, vec_id, v) and queries (shard, vec_id, v, reach): a task reads a shard's rows, then its queries."""
    both = base.select("shard", F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("double").alias("reach")).unionByName(asked.select("shard", F.lit(1).alias("kind"), "vec_id", "v", "reach"))
    sent = base.sparkSession.sparkContext.broadcast(plane)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows, index = None, [], [], None
        for batch in batches:
            shard, kind, own = (batch.column(i).to_numpy() for i in range(3))
            vectors, reach = _matrix(batch.column(3)), batch.column(4).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(shard)]
            out: list[tuple[int, int, float]] = []
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if shard[a] != now:
                    now, ids, rows, index = shard[a], [], [], None
                if kind[a] == 0:
                    ids.append(own[a:b])
                    rows.append(vectors[a:b])
                elif ids:
                    if index is None:
                        index, rows = Shard(np.concatenate(ids), np.vstack(rows), sent.value, k), []
                    for i in range(a, b):
                        out += [(int(own[i]), x, d) for d, x in index.search(int(own[i]), vectors[i], confidence, reach[i])]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], names=["query_id", "vec_id", "score"])

    dealt = both.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_neighbours(rows: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, confidence: float = CONFIDENCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k nearest rows other than its own id."""
    spark = rows.sparkSession
    one_thread(spark)
    base, asked = sound(rows, vec_id, vector), sound(queries, vec_id, vector)
    usual = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return base.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    plane = plane_of(usual["n"], dims)
    base = _few_copies(base.where(F.size("v") == usual["n"]), k)
    asked = asked.where(F.size("v") == usual["n"]).groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))

    share = min(1.0, SAMPLE / usual["count"])
    some = base.where(F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toArrow()  # about SAMPLE rows
    points = _matrix(some["v"]) @ plane if some.num_rows else np.zeros((0, dims))
    cells = Cells(points, max(1, min(-(-usual["count"] // shard_rows), len(points) // PER_CELL)))

    placed = materialise(_in_cells(base, cells, plane))
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(F.get("p", F.lit(i))).alias(f"{s}{i}") for i in range(dims) for s, f in (("lo", F.min), ("hi", F.max))]).orderBy("cell").collect()  # a row per cell
    parts = np.array([-(-r["n"] // shard_rows) for r in boxes])
    first = np.cumsum(parts) - parts
    numbers = [r["cell"] for r in boxes]
    low, high = (np.array([[r[f"{s}{i}"] for i in range(dims)] for r in boxes]) for s in ("lo", "hi"))
    shards = int(parts.sum())
    of_cell = spark.createDataFrame(list(zip(numbers, first.tolist(), parts.tolist(), strict=True)), "cell int, first int, parts int")
    spread = placed.join(F.broadcast(of_cell), "cell").select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("shard"), "vec_id", "v")
    tell = materialise(_in_cells(asked, cells, plane))

    every = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("shard")
    begun = _searched(spread, tell.join(F.broadcast(of_cell), "cell").select(every, "vec_id", "v", F.lit(float("inf")).alias("reach")), plane, k, confidence, shards)
    near = materialise(_best(begun, k).drop("rank"))
    # no reach where fewer than k were found
    reach = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.max("score")).otherwise(F.lit(float("inf"))).alias("reach"))
    left = tell.join(reach.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("vec_id", "v", "cell", "p", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    sent = spark.sparkContext.broadcast((numbers, low, high, first, parts))
    kind = tell.schema["v"].dataType.simpleString()

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lo, hi, begin, n = sent.value
        number = np.array(own)
        for batch in batches:
            if not batch.num_rows:
                continue
            far, cell, take, to = batch.column(4).to_numpy(), batch.column(2).to_numpy(), [], []
            for i, p in enumerate(_matrix(batch.column(3))):
                gap = np.maximum(np.maximum(lo - p, p - hi), 0)
                bound = (gap * gap).sum(1)
                open_ = [c for c in np.flatnonzero(number != cell[i]) if far[i] == math.inf or bound[c] == 0 or (far[i] > 0 and chi_square(bound[c] / far[i] ** 2, lo.shape[1]) < confidence)]
                mine = [s for c in open_ for s in range(begin[c], begin[c] + n[c])]
                take += [i] * len(mine)
                to += mine
            rest = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), rest.column(0), rest.column(1), rest.column(4)], names=["shard", "vec_id", "v", "reach"])

    further = _searched(spread, left.mapInArrow(others, f"shard int, vec_id bigint, v {kind}, reach double"), plane, k, confidence, shards)
    found = _best(near.unionByName(further), k)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
