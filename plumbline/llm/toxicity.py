"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Examples are at most ``sample`` labelled documents (the ids with the smallest hashes), each over all its words; document
frequencies are counted over all documents. Words that toxic examples use more often than chance allows (chi-square at
least ``CHI``, in ``LEAST`` toxic examples or more) weigh ``BOOST`` times as much; no word and no example leaves the
index.

The index is inverted. Lists of rare words are short and are read whole. Lists of the ``HEAD`` words of most examples are
long; they are cut into blocks of ``BLOCK`` examples and keep the largest weight of each block. What the short lists give
a block at most, and the block maxima of the long ones, bound every cosine in it. A batch of texts first opens the blocks
of the largest bounds; the k-th best cosine found there closes all blocks whose bound is below it, and only the others
are opened. So the neighbours are exact. Examples lie in the order of clusters (by language and subject, as it comes),
which keeps the bounds low.

Votes weigh by inverse distance and are drawn towards the share of toxic examples, which is also the score of a text
without a word of any example. Two numbers, a scale and a shift of the votes' log odds, calibrate them; they are fit on
the votes that all examples get from the others.

Defined results: a null or empty text scores that share; without examples every score is 0; rows with null ids are never
learned from; an id with several labels counts by its largest, one with several texts by the first of them; equal cosines go to the smaller id; repeated rows each get
their own row; a text of any length is read whole, its memory is that of its distinct words; extra columns are ignored
unless passed through ``keep``, whose names must not be score or evidence.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import discard, letter_words, materialise, one_thread, schema_with, smallest_hashes

SAMPLE, CHI, LEAST, NEAREST = 5_000, 20.0, 3, 15
BOOST, HEAD, BATCH = 4.0, 256, 100
BLOCK, FIRST, CLUSTERS = 64, 8, 32


class Index:
    """Unit TF-IDF vectors of the examples. Terms are numbered by falling number of examples; the first ``head`` are dense."""

    def __init__(self, idf: dict[str, float], ids: Iterable[int], counts: Iterable[dict[str, int]], labels: Iterable[int], prior: float, head: int = HEAD):
        number = {t: i for i, t in enumerate(idf)}
        known = [[(number[t], n) for t, n in c.items() if t in number] for c in counts]
        pairs = np.array([x for c in known for x in c], np.int32).reshape(-1, 2)
        self.state = "\n".join(idf), np.fromiter(idf.values(), float), np.fromiter(ids, np.int64), np.fromiter(labels, np.int64), np.array([len(c) for c in known], np.int32), pairs[:, 0], pairs[:, 1], prior, head
        self._build()

    @classmethod
    def of_arrays(cls, *state) -> Index:
        """Terms joined by line feeds, weights, ids, labels, sizes, and of all examples in turn the term numbers and counts, prior, head, scale and shift of the votes' odds (1 and 0 if left out). Built where it is read."""
        index = cls.__new__(cls)
        index.state = state
        return index

    def __getstate__(self) -> bytes:
        return zlib.compress(pickle.dumps(self.state, protocol=5), 1)

    def __setstate__(self, packed: bytes) -> None:
        self.state = pickle.loads(zlib.decompress(packed))
        self._build()

    def _build(self) -> None:
        names, weight, self.ids, self.labels, sizes, term, count, self.prior, head, *odds = self.state
        self.odds = Odds(*odds)
        names = names.split("\n") if len(weight) else []
        # the most frequent terms first
        order = np.argsort(-np.bincount(term, minlength=len(names)), kind="stable")
        place = np.empty(len(names), np.int32)
        place[order] = np.arange(len(names), dtype=np.int32)
        self.number, self.weight = {names[i]: k for k, i in enumerate(order.tolist())}, weight[order]
        term, at = place[term], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        by = np.lexsort((at, term))
        term, at = term[by], at[by]
        w = (1 + np.log(count[by])) * self.weight[term]
        norm = np.sqrt(np.bincount(at, w * w, minlength=len(sizes)))
        w /= norm[at]
        self.head = min(head, len(names))
        n, ends = len(self.ids), np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(names)))])
        first = ends[self.head]
        dense = np.zeros((n, self.head))
        dense[at[:first], term[:first]] = w[:first]
        line = _clustered(dense)
        self.ids, self.labels = self.ids[line], self.labels[line]
        where = np.empty(n, np.int32)
        where[line] = np.arange(n, dtype=np.int32)
        self.short = where[at[first:]] + 1j * w[first:]  # places and weights in one array, so that a list is one slice
        self.cut = ends - first
        self.blocks = -(-n // BLOCK)
        rows = np.zeros((self.blocks * BLOCK, self.head))
        rows[:n] = dense[line]
        self.long = np.ascontiguousarray(rows.reshape(self.blocks, BLOCK, self.head).transpose(0, 2, 1))
        self.most = np.ascontiguousarray(self.long.max(2).T) if n else np.zeros((self.head, 0))

    def encode(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of the terms that the index knows, as a unit vector."""
        i = np.fromiter(map(self.number.get, counts, repeat(-1)), np.int32, len(counts))
        n = np.fromiter(counts.values(), np.float64, len(counts))[i >= 0]
        i = i[i >= 0]
        order = np.argsort(i)
        i = i[order]
        v = (1 + np.log(n[order])) * self.weight[i]
        norm = np.sqrt(v @ v)
        return (i, v / norm) if norm > 0 else (i[:0], v[:0])

    def vector(self, counts: dict[str, int]) -> dict[str, float]:
        known = {n: t for t in counts if (n := self.number.get(t)) is not None}
        return {known[n]: x for n, x in zip(*(a.tolist() for a in self.encode(counts)), strict=True)}

    def search(self, batch: list[tuple[np.ndarray, np.ndarray]], k: int = NEAREST) -> list[list[tuple[float, int, int]]]:
        """Per encoded text (cosine, id, label) of the k nearest examples, best first; those without a common word are none."""
        if not len(self.ids) or not batch:
            return [[] for _ in batch]
        asked = np.zeros((len(batch), self.head))
        got = np.zeros((len(batch), self.blocks, BLOCK))
        for r, (i, v) in enumerate(batch):
            far = i >= self.head
            asked[r, i[~far]] = v[~far]
            a, b = self.cut[i[far]], self.cut[i[far] + 1]
            parts = [self.short[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            if parts:
                met = np.concatenate(parts)
                got[r] = np.bincount(met.real.astype(np.int64), met.imag * np.repeat(v[far], b - a), self.blocks * BLOCK).reshape(self.blocks, BLOCK)
        bound = got.max(2) + asked @ self.most

        def opened(live: np.ndarray) -> None:
            for b in np.flatnonzero(live.any(0)):
                r = np.flatnonzero(live[:, b])
                got[r, b] += asked[r] @ self.long[b]

        first = min(self.blocks, max(FIRST, -(-k // BLOCK)))
        best = np.argpartition(bound, self.blocks - first, axis=1)[:, self.blocks - first :]
        live = np.zeros(bound.shape, bool)
        np.put_along_axis(live, best, True, 1)
        opened(live)
        seen = np.take_along_axis(got, best[:, :, None], 1).reshape(len(batch), -1)
        floor = np.partition(seen, seen.shape[1] - k, 1)[:, seen.shape[1] - k] - 1e-9 if seen.shape[1] > k else np.zeros(len(batch))
        opened(~live & (bound >= floor[:, None]))
        out = []
        for least, whole in zip(floor, got.reshape(len(batch), -1), strict=True):
            place = np.flatnonzero((whole >= least) & (whole > 0))
            near = np.round(whole[place], 12)  # equal examples are equal in whatever order their products are summed
            best = np.lexsort((self.ids[place], -near))[:k]
            place = place[best]
            out.append(list(zip(near[best].tolist(), self.ids[place].tolist(), self.labels[place].tolist(), strict=True)))
        return out

    def nearest(self, v: dict[str, float], k: int = NEAREST) -> list[tuple[float, int, int]]:
        known = sorted((self.number[t], x) for t, x in v.items() if t in self.number)
        return self.search([(np.array([n for n, _ in known], np.int32), np.array([x for _, x in known], float))], k)[0]

    def vote(self, v: dict[str, float]) -> tuple[float, list[tuple[float, int, int]]]:
        near = self.nearest(v) if v else []
        return self.tally(near), near

    def tally(self, near: list[tuple[float, int, int]]) -> float:
        if not near:
            return self.prior
        weights = [1 / (1.05 - c) for c, _, _ in near]
        vote = (0.5 * self.prior + sum(w * y for w, (_, _, y) in zip(weights, near, strict=True))) / (0.5 + sum(weights))
        return self.odds.score(vote)


class Odds:
    """Votes to calibrated scores: a scale and a shift of their log odds, fit by maximum likelihood. The scale is above zero, so the order of votes stays."""

    def __init__(self, scale: float = 1.0, shift: float = 0.0):
        self.scale, self.shift = scale, shift

    @staticmethod
    def of(vote: np.ndarray) -> np.ndarray:
        v = np.clip(vote, 1e-6, 1 - 1e-6)
        return np.log(v / (1 - v))

    @classmethod
    def fit(cls, votes: np.ndarray, labels: np.ndarray) -> Odds:
        """Newton steps with a small ridge towards (1, 0); one class alone leaves the votes as they are."""
        if len(np.unique(labels)) < 2:
            return cls()
        z, y, ridge = cls.of(votes), labels.astype(float), 1.0
        now = np.array([1.0, 0.0])
        loss = lambda t: np.logaddexp(0, -(2 * y - 1) * (t[0] * z + t[1])).sum() + 0.5 * ridge * ((t - [1, 0]) ** 2).sum()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(now[0] * z + now[1], -500, 500)))
            gap, slope = p - y, p * (1 - p)
            grad = np.array([gap @ z, gap.sum()]) + ridge * (now - [1, 0])
            step = np.linalg.solve(np.array([[slope @ (z * z), slope @ z], [slope @ z, slope.sum()]]) + ridge * np.eye(2), grad)
            size = 1.0
            while loss(now - size * step) > loss(now) and size > 1e-6:
                size /= 2
            now = now - size * step
            if np.abs(size * step).max() < 1e-10:
                break
        return cls(*now.tolist()) if now[0] > 0 else cls()

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.scale * self.of(np.float64(vote)) + self.shift))))


def _clustered(rows: np.ndarray, rounds: int = 4) -> np.ndarray:
    """An order of the rows in which those of one cluster are neighbours; any order gives the same neighbours."""
    if len(rows) <= BLOCK or not rows.shape[1]:
        return np.arange(len(rows))
    centre = rows[np.linspace(0, len(rows) - 1, CLUSTERS).astype(int)]
    for _ in range(rounds):
        near = (rows @ (centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)).T).argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, rows)
        centre = np.where(np.bincount(near, minlength=CLUSTERS)[:, None] > 0, sums, centre)
    return np.argsort(near, kind="stable")


def train(docs: DataFrame, every: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Index:
    """``docs``: (doc_id, text) to learn from, ``labels``: (doc_id, toxic) to learn from, ``every``: (text) of all documents, for document frequencies."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    roles = docs.sparkSession.createDataFrame(smallest_hashes(marked, sample).toPandas(), "doc_id bigint, toxic int")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [list(letter_words(t).items()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.map_(pa.string(), pa.int32()))], names=["doc_id", "toxic", "counts"])

    # one text per id, so that the bound on ids is one on examples
    texts = docs.select("doc_id", "text").join(F.broadcast(roles), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    mine = texts.select("doc_id", "toxic", "text").mapInArrow(terms, "doc_id bigint, toxic int, counts map<string,int>")
    examples = materialise(mine)
    size = examples.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")).first()
    n, bad = size["n"], size["bad"] or 0
    if not n:
        return Index({}, [], [], [], 0.0)
    a, rest = F.col("a").cast("double"), F.col("df") - F.col("a")
    table = examples.select("toxic", F.explode(F.map_keys("counts")).alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("df")).where(f"a >= {LEAST}")
    cross = a * (n - bad - rest) - rest * (bad - a)
    below = F.col("df") * (n - F.col("df")) * F.lit(float(bad)) * (n - bad)
    boosted = {r["term"] for r in table.where((cross > 0) & (n * cross * cross >= CHI * below)).select("term").collect()}
    rows = examples.toArrow().combine_chunks().sort_by("doc_id")
    maps = rows.column("counts").combine_chunks()
    words = pc.unique(maps.keys)
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows, vocabulary = Counter(), 0, frozenset(sent.value.to_pylist())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for t in batch.column(0).slice(at, 500).to_pylist():
                    rows += 1
                    seen.update(vocabulary.intersection(letter_words(t)))
        yield pa.RecordBatch.from_arrays([pa.array([None, *seen], pa.string()), pa.array([rows, *seen.values()], pa.int64())], names=["term", "df"])

    counted = every.select("text").mapInArrow(present, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    total = pc.sum(counted.filter(pc.is_null(counted["term"]))["df"]).as_py() or 0
    df = pc.fill_null(counted["df"].combine_chunks().take(pc.index_in(words, counted["term"].combine_chunks())), 0).to_numpy(zero_copy_only=False)
    weight = (np.log((1 + total) / (1 + df)) + 1) * np.where(pc.is_in(words, pa.array(sorted(boosted), pa.string())).to_numpy(zero_copy_only=False), BOOST, 1.0)
    sizes = np.diff(maps.offsets.to_numpy()).astype(np.int32)
    term, count = pc.index_in(maps.keys, words).to_numpy().astype(np.int32), maps.items.to_numpy().astype(np.int32)
    state = "\n".join(words.to_pylist()), weight, rows["doc_id"].to_numpy(), rows["toxic"].to_numpy().astype(np.int64), sizes, term, count, (bad + 0.5) / (n + 1), HEAD
    odds = _cross_fit(examples, Index.of_arrays(*state))
    discard(examples)
    return Index.of_arrays(*state, odds.scale, odds.shift)


def _cross_fit(examples: DataFrame, index: Index) -> Odds:
    """The calibration that fits the votes of all examples (doc_id, toxic, counts), each without itself; two numbers per example come back."""
    sent = examples.sparkSession.sparkContext.broadcast(index)
    one_thread(examples.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                found = own.search([own.encode(dict(c)) for c in batch.column(2).to_pylist()], NEAREST + 1)
                votes = [own.tally([x for x in near if x[1] != i][:NEAREST]) for i, near in zip(batch.column(0).to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(votes, pa.float64())], names=["doc_id", "toxic", "vote"])

    rows = examples.mapInArrow(run, "doc_id bigint, toxic int, vote double").toArrow().sort_by("doc_id")
    sent.unpersist()
    return Odds.fit(rows["vote"].to_numpy(), rows["toxic"].to_numpy())


def score(docs: DataFrame, index: Index, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, score, and ``evidence``: the nearest examples' ids, cosines and labels."""
    source = docs.select(*keep, F.col(text).alias("_t"))
    fields = source.schema.fields[:-1]
    sent = docs.sparkSession.sparkContext.broadcast(index)
    one_thread(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                found = own.search([own.encode(letter_words(t)) for t in batch.column(batch.num_columns - 1).to_pylist()])
                flat = [x for near in found for x in near]
                parts = [pa.array([x[1] for x in flat], pa.int64()), pa.array([x[0] for x in flat], pa.float64()), pa.array([x[2] for x in flat], pa.int32())]
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                evidence = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, names=["doc_id", "cosine", "toxic"]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(map(own.tally, found), pa.float64()), evidence], names=[*batch.schema.names[:-1], "score", "evidence"])

    return source.mapInArrow(run, schema_with(fields, "score double, evidence array<struct<doc_id:bigint,cosine:double,toxic:int>>"))
