"""Language identification with word-first backoff.

Counts cover every training text: how often each language uses each word, and each character 4- to 1-gram of its words.
The model keeps what makes up at least ``floor`` of a language's words (or of its grams of one length), so it holds at
most 1 / floor entries per language and length, whatever the corpus; that is the bound of the broadcast. A word of the
model scores its log frequency per language. An unseen word falls back: at each place the longest gram that the model
knows, from four characters down to one, scores by its log frequency, divided by its length.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text where nothing could be
learned; ties go to the language first by code point; rows with null ids are never learned from; repeated rows each get
their own row; a text of any length is read whole, its memory is that of its distinct words; extra columns are ignored
unless passed through ``keep``, whose names must not be lang_pred or score.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import let, letter_words, materialise, schema_with

FLOOR = 1e-6
LONGEST = 4
ROWS = 300_000
ENTRIES = 200_000
def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, n) of rows (lang, text): words counted inside each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flushed() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, words in held.items() for w, n in words.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.setdefault(lang, Counter()).update(letter_words(text))
            if sum(map(len, held.values())) > ENTRIES:
                yield flushed()
        yield flushed()

    return texts.select("lang", "text").mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def gram_counts(texts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, size, gram, n) of rows (lang, text): size 0 holds words, the others the character grams of words between ``<`` and ``>``."""
    words = materialise(word_counts(texts))

    def cut(w, n: int):
        return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.struct(F.lit(n).alias("size"), F.substring(w, i, F.lit(n)).alias("gram")))).otherwise(F.array().cast("array<struct<size:int,gram:string>>"))

    grams = let(F.concat(F.lit("<"), F.col("gram"), F.lit(">")), lambda w: F.concat(*[cut(w, n) for n in range(1, longest + 1)]))
    each = words.select("lang", "n", F.explode(grams).alias("g")).groupBy("lang", "g.size", "g.gram").agg(F.sum("n").alias("n"))
    return words.select("lang", F.lit(0).alias("size"), "gram", "n").unionByName(each)


class Languages:
    """Log frequencies by language of words and grams. It travels as arrays; the tables that words are looked up in are made where it is read."""

    def __init__(self, rows: pa.Table, floor: float):
        """``rows``: (lang, size, gram, share); size 0 are words. What a language lacks counts as half of ``floor``."""
        self.langs = sorted(pc.unique(rows["lang"]).to_pylist(), key=lambda x: x.encode())
        column = pc.index_in(rows["lang"], pa.array(self.langs, pa.string())).to_numpy()
        size, low = rows["size"].to_numpy(), math.log(floor / 2)
        logs = np.log(rows["share"].to_numpy()) / np.maximum(size, 1)
        self.longest = int(size.max(initial=1))

        def part(at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
            grams = rows["gram"].filter(pa.array(at)).combine_chunks()
            names = pc.unique(grams)
            # a gram that a language lacks counts by its length as well
            lacks = low / pc.utf8_length(names).to_numpy() if at is not word else np.full(len(names), low)
            found = np.repeat(lacks.astype(np.float32)[:, None], len(self.langs), 1)
            found[pc.index_in(grams, names).to_numpy(), column[at]] = logs[at]
            return names, found

        word = size == 0
        self.names, self.word_logs = part(word)
        self.gram_names, self.gram_logs = part(~word)

    @functools.cached_property
    def words(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.names.to_pylist())}

    @functools.cached_property
    def grams(self) -> dict[str, int]:
        return {g: i for i, g in enumerate(self.gram_names.to_pylist())}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "grams")}

    def of_word(self, word: str) -> np.ndarray:
        if word in self.words:
            return self.word_logs[self.words[word]]
        whole, found = f"<{word}>", []
        for i in range(len(whole)):
            for n in range(min(self.longest, len(whole) - i), 0, -1):
                at = self.grams.get(whole[i : i + n])
                if at is not None:
                    found.append(at)
                    break
        return self.gram_logs[found].sum(0) / max(1, len(found)) if found else np.zeros(len(self.langs), np.float32)


class Rows(dict):
    """Words to rows of a bounded matrix of their scores."""

    def __init__(self, model: Languages):
        self.model, self.matrix = model, np.empty((ROWS, len(model.langs)), np.float32)

    def __missing__(self, word: str) -> int:
        at = len(self)
        self.matrix[at] = self.model.of_word(word)
        self[word] = at
        return at


def classify(texts: list[str | None], model: Languages, rows: Rows) -> tuple[list[str], list[float]]:
    named, scores = [], []
    for t in texts:
        words = letter_words(t)
        if not words or not model.langs:
            named.append("und")
            scores.append(0.0)
            continue
        total, keys, counts = np.zeros(len(model.langs)), list(words), list(words.values())
        for at in range(0, len(keys), ROWS // 2):
            part = keys[at : at + ROWS // 2]
            if len(rows) + len(part) > ROWS:
                rows.clear()
            total += np.array(counts[at : at + ROWS // 2], np.float64) @ rows.matrix[np.fromiter(map(rows.__getitem__, part), np.int64, len(part))]
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        named.append(model.langs[best])
        scores.append(float(odds[best] / odds.sum()))
    return named, scores


_kept: list = []


def rows_of(model: Languages) -> Rows:
    """The scores that this worker process has kept of the model."""
    if not _kept or _kept[0].model is not model:
        _kept[:] = [Rows(model)]
    return _kept[0]


def train(texts: DataFrame, floor: float = FLOOR, longest: int = LONGEST) -> Languages:
    """A model of rows (lang, text)."""
    counts = materialise(gram_counts(texts.where("lang is not null"), longest))
    sums = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    # a row per language and length of gram
    frequent = counts.join(F.broadcast(sums), ["lang", "size"]).where(F.col("n") >= F.col("total") * floor)
    return Languages(frequent.select("lang", "size", "gram", (F.col("n") / F.col("total")).alias("share")).toArrow(), floor)


def identify(docs: DataFrame, model: Languages, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, lang_pred and score, per row."""
    source = docs.select(*keep, F.col(text).alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = source.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = rows_of(sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                named, scores = classify(batch.column(batch.num_columns - 1).to_pylist(), sent.value, mine)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(named, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return source.mapInArrow(run, schema_with(fields, "lang_pred string, score double"))
