"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled as good; unlabelled web text is all documents. With an estimate pi of the class
prior, a small network minimises the non-negative unbiased risk pi R_p(+) + max(0, R_u(-) - pi R_p(-)) with the logistic
loss; where the second part falls below zero, its gradient is followed backwards instead. No label of a bad document is
used anywhere.

The class prior comes from positives and unlabelled documents too. A first network tells half of the positives from
unlabelled documents. Among those above any of its scores, the share of unlabelled documents is at least pi times the
share of positives, so pi is at most their ratio; the smallest ratio over scores that most of the other positives pass is
the estimate. Positives held back give the one share, every unlabelled document the other.

Features are counts over the whole text, made in one pass over bytes and words and kept as numbers. Their means and
scales cover all documents. The networks are fit on the driver by stochastic gradients, which draw from at most
``sample`` positives and ``sample`` unlabelled documents (the ids with the smallest hashes).

Defined results: a null or empty text is scored like any other, by the features of an empty text; where there are no
positives or no documents to learn from, every score is one half; rows with null ids are never learned from; an id with
several quality labels counts by its largest, one with several rows is drawn as one, with the least of their features;
ties and repeated rows score alike, each in its own row; a text of any
length is read whole, its memory a few times its own; extra columns are ignored unless passed through ``keep``, whose
names must not be x or score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import schema_with, smallest_hashes

SAMPLE, HIDDEN, STEPS, BATCH, SEED = 20_000, 24, 3_000, 512, 11
#: Cuts of the first network's scores that at least a share ``MOST`` of the positives pass.
CUTS, MOST = 20, 0.5
_BYTE_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\n\r\x0b\x0c", b".,;:'\"", b"!?", b"|", b"#*$%&<>~^=+_\\/@{}[]()", range(128, 256)), 1):
    _BYTE_CLASS[list(_chars)] = _i
NAMES = 10 + 13


def features(text: bytes | None) -> np.ndarray:
    """Shares of byte classes and measures of words, lines and repetition; log scales for lengths."""
    raw = text or b""
    out = np.zeros(NAMES)
    n = len(raw)
    if n:
        out[:10] = np.bincount(_BYTE_CLASS[np.frombuffer(raw, np.uint8)], minlength=10) / n
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = len(words)
    if m:
        seen = Counter(words)
        pairs = set(zip(words, words[1:], strict=False))
        triples = set(zip(words, words[1:], words[2:], strict=False))
        sizes = np.fromiter(map(len, words), np.float64, m)
        most = seen.most_common(1)[0][1]
        out[10:] = (
            np.log1p(m) / 5, np.log1p(n) / 6, sizes.mean() / 8, sizes.std() / 6, min(sizes.max(), 200) / 40, len(seen) / m, most / m,
            (len(pairs) / (m - 1) if m > 1 else 1.0), (len(triples) / (m - 2) if m > 2 else 1.0),
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
            1 - len(set(lines)) / max(1, len(lines)), np.log1p(m / max(1, len(lines))) / 4, float(m < 10),
        )
    return out


def featured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``x``, the features of the text, per row."""
    source = docs.select(*keep, F.col(text).cast("binary").alias("_t"))
    fields = source.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = [features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "x"])

    return source.mapInArrow(run, schema_with(fields, "x array<double>"))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Network:
    """One hidden layer over standardised features, fit by Adam. With a ``prior`` it minimises the non-negative risk, without it tells positives from unlabelled rows."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, prior: float | None):
        self.mean, self.scale, self.prior = mean, scale, prior
        self.parts: list[np.ndarray] | None = None

    def risk(self, parts: list[np.ndarray], p: np.ndarray, u: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The risk of a batch of standardised positives and unlabelled rows, and the gradients to follow."""
        gp, gu = self._raw(parts, p), self._raw(parts, u)
        both = np.concatenate([p, u])
        if self.prior is None:
            loss = np.logaddexp(0, -gp).mean() + np.logaddexp(0, gu).mean()
            return loss, self._grads(parts, both, np.concatenate([-sigmoid(-gp) / len(p), sigmoid(gu) / len(u)]))
        found = self.prior * np.logaddexp(0, -gp).mean()
        rest = np.logaddexp(0, gu).mean() - self.prior * np.logaddexp(0, gp).mean()
        # gradients in the outputs: of R_p(+), R_p(-) and R_u(-)
        up, pn, un = -self.prior * sigmoid(-gp) / len(p), self.prior * sigmoid(gp) / len(p), sigmoid(gu) / len(u)
        return found + max(0.0, rest), self._grads(parts, both, np.concatenate([up - pn, un]) if rest >= 0 else np.concatenate([pn, -un]))

    def fit(self, good: np.ndarray, any_: np.ndarray, steps: int = STEPS, hidden: int = HIDDEN, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        p, u = self._standard(good), self._standard(any_)
        d = p.shape[1]
        parts = [rng.standard_normal((d, hidden)) / np.sqrt(d), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1), np.zeros(d)]
        first, second = [np.zeros_like(x) for x in parts], [np.zeros_like(x) for x in parts]
        for step in range(1, steps + 1):
            _, grads = self.risk(parts, p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)])
            rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
            for i, g in enumerate(grads):
                g = g + 1e-4 * parts[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                parts[i] = parts[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        self.parts = parts
        return self

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    @staticmethod
    def _raw(parts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        w, b, v, c, direct = parts
        return np.tanh(x @ w + b) @ v + c[0] + x @ direct

    @staticmethod
    def _grads(parts: list[np.ndarray], x: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        w, b, v, _, _ = parts
        h = np.tanh(x @ w + b)
        back = g[:, None] * v * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ g, np.array([g.sum()]), x.T @ g]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), 0.5)
        return sigmoid(self._raw(self.parts, self._standard(x)))


def prior_of(passed: np.ndarray, n_any: np.ndarray, total: int) -> float:
    """The class prior from the shares of held-back positives and the counts of unlabelled rows above each cut, one of all cuts being below every score."""
    ratio = n_any / max(1, total) / np.maximum(passed, 1e-9)
    return float(np.clip(ratio[passed >= MOST].min(initial=1.0), 0.01, 0.99))


def _above(rows: DataFrame, net: Network, cuts: np.ndarray) -> np.ndarray:
    """How many rows (x) score above each cut: one row per task leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(cuts), np.int64)
        for batch in batches:
            if batch.num_rows:
                counts += (net.score(_matrix(batch.column(0)))[:, None] >= cuts).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array(counts)], names=["cut", "n"])

    found = rows.select("x").mapInArrow(run, "cut int, n bigint").groupBy("cut").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(cuts), np.int64)
    for r in found:
        out[r["cut"]] = r["n"]
    return out


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def train(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """``rows``: (doc_id, x) of all documents to learn from, better written than derived, as they are read several times; ``labels``: (doc_id, quality) to learn from."""
    spark = rows.sparkSession
    good_ids = labels.where("doc_id is not null and quality = 1").select("doc_id").distinct()
    sums = rows.agg(F.count("x").alias("n"), *[f(F.get("x", F.lit(i))).alias(f"{k}{i}") for i in range(NAMES) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    known = rows.where("doc_id is not null").select("doc_id").distinct()
    roles = [smallest_hashes(d, sample).withColumn("good", F.lit(g)) for d, g in ((known.join(good_ids, "doc_id", "left_semi"), True), (known, False))]
    chosen = spark.createDataFrame(roles[0].unionByName(roles[1]).distinct().toPandas(), "doc_id bigint, good boolean")
    # one row of numbers per id and role, so at most 2 * sample
    got = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "good").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id")
    good, any_ = got[got.good], got[~got.good]
    if not sums["n"] or not len(good) or not len(any_):
        return Network(np.zeros(NAMES), np.ones(NAMES), None)
    # rounded, as sums of doubles depend on their order in the last digits
    mean, scale = (np.round([sums[f"{k}{i}"] for i in range(NAMES)], 6) for k in "ms")
    good, any_ = np.stack(good.x.to_numpy()), np.stack(any_.x.to_numpy())
    half = np.arange(len(good)) % 2 == 0
    if half.all():
        prior = 0.5
    else:
        first = Network(mean, scale + 1e-3, None).fit(good[half], any_, steps=STEPS // 3)
        told = first.score(good[~half])
        cuts = np.append(np.quantile(told, np.linspace(0, 1 - MOST, CUTS)), 0.0)
        prior = prior_of((told[:, None] >= cuts).mean(0), _above(rows, first, cuts), sums["n"])
    return Network(mean, scale + 1e-3, prior).fit(good, any_)


def score(rows: DataFrame, net: Network, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and score, per row of features ``x``."""
    source = rows.select(*keep, "x")
    fields = source.schema.fields[:-1]
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = sent.value.score(_matrix(batch.column(batch.num_columns - 1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], "score"])

    return source.mapInArrow(run, schema_with(fields, "score double"))
