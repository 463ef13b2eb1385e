"""Subword tokens with their places in the text, and contexts cut to what a model holds.

A byte-level tokenizer cuts a text's bytes, so tokens have places among bytes; the text is told in code points. A map from
bytes to code points, one pass over the bytes, gives each token the half-open range of the code points it touches: two
tokens that share the bytes of one sign both have it. The tokenizer is a file, given by its path, which each task reads
once.

Words are encoded once: where the file cuts texts by the usual byte-level pattern and nothing else, a text's tokens are
those of its words, which the library's model gives and a bounded memo keeps. Any other file takes whole texts through
the library. A task holds the tokens of one text, or of few short ones, at a time.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from plumbline.operators.intervals import held_points, sentence_places

_OFFSETS = StructType([StructField(n, ArrayType(IntegerType())) for n in ("ids", "starts", "ends")])
_FIT = StructType([StructField("n_tokens", IntegerType()), StructField("read_tokens", IntegerType()), StructField("read_chars", IntegerType()), StructField("seq_len", IntegerType()), StructField("cut", BooleanType())])


@functools.cache
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # a special token's string in a text is ordinary text
    t.no_truncation()
    t.no_padding()
    return t


#: How a byte-level tokenizer cuts words unless its file says otherwise; letters come first, as no other branch can start where they do.
WORDS = r" ?\p{L}++| ?\p{N}++|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
MEMO, SHORT = 1 << 17, 64


class _Words(dict):
    """Words to their ids as 32-bit integers, as the library's model gives them; a bounded memo.

    The pattern and the library may know different versions of Unicode, so texts with signs that Python's own does not
    know go to the library whole.
    """

    def __init__(self, tokenizer):
        import regex
        from tokenizers import pre_tokenizers

        self.tokenizer, self.model, self.find = tokenizer, tokenizer.model, regex.compile(WORDS).findall
        self.new = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])
        as_signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.signs = lambda word: as_signs(word)[0][0]  # a sign for each byte

    def __missing__(self, word: str) -> bytes:
        found = np.array([t.id for t in self.model.tokenize(self.signs(word))], np.int32).tobytes()
        if len(word) <= SHORT:
            if len(self) >= MEMO:
                self.clear()
            self[word] = found
        return found

    def ids(self, text: str) -> np.ndarray:
        if not text.isascii() and self.new[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        return np.frombuffer(b"".join(map(self.__getitem__, self.find(text))), np.int32)


@functools.cache
def _ids(path: str) -> Callable[[str], np.ndarray]:
    """The ids of a text's tokens, by its words where the file allows it."""
    t = _tokenizer(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    plain = plain and spec["normalizer"] is None and model.get("type") == "BPE" and not model.get("dropout") and all(x["special"] for x in spec["added_tokens"])
    return _Words(t).ids if plain else lambda text: np.array(t.encode(text, add_special_tokens=False).ids, np.int32)


@functools.cache
def _token_bytes(path: str) -> np.ndarray:
    """How many bytes each token has: each sign of a byte-level token's string stands for one."""
    found = _tokenizer(path).get_vocab()
    out = np.zeros(max(found.values(), default=-1) + 1, np.int64)
    for token, i in found.items():
        out[i] = len(token)
    return out


def byte_places(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open ranges in code points of tokens that are so many bytes long."""
    raw = np.frombuffer(text.encode(), np.uint8)
    sign = np.cumsum((raw & 0xC0) != 0x80) - 1  # the code point of each byte
    ends = np.cumsum(lengths)
    if len(raw) != (ends[-1] if len(ends) else 0):
        raise ValueError("tokens do not make up the text: the tokenizer is not a byte-level one")
    return sign[ends - lengths].astype(np.int32), (sign[ends - 1] + 1).astype(np.int32)


def _encoded(path: str, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, starts and ends, a text at a time."""
    ids_of, sizes = _ids(path), _token_bytes(path)
    for t in texts:
        ids = ids_of(t)
        yield ids, *byte_places(t, sizes[ids])


def _pieces(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of rows that have about so much in all; a row is never cut."""
    run = np.cumsum(sizes, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
    for a, b in zip(edges, edges[1:]):
        yield a, b - a


def subword_offsets(path: str) -> Callable[[Column], Column]:
    """Column function: ids, starts and ends of a text's subword tokens; NULL has none."""

    @pandas_udf(_OFFSETS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, n in _pieces(batch.str.len().fillna(0).to_numpy()):  # a batch's tokens take many times the memory of its texts
                yield pd.DataFrame(list(_encoded(path, [t or "" for t in batch.iloc[at : at + n]])), columns=["ids", "starts", "ends"])

    return run


def subwords_in_sentences(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, the starts and ends of a text's subword tokens, and lo and hi, the range of the tokens that start inside each sentence.

    One pass in one Python worker a task: chained column functions would hold a worker, and a batch of all tokens, each.
    """
    source = docs.select(*keep, F.col(text).alias("_text"))
    names = ["starts", "ends", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.drop_columns(["_text"])
            sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False)
            for at, n in _pieces(sizes):
                own = pd.Series(batch.column("_text").slice(at, n).to_pylist(), dtype=object).fillna("")
                found = list(_encoded(path, own))
                sent = sentence_places.func(own)
                held = held_points.func(pd.Series([s for _, s, _ in found]), sent["starts"], sent["ends"])
                arrays = [[s for _, s, _ in found], [e for _, _, e in found], held["lo"], held["hi"]]
                yield pa.RecordBatch.from_arrays([*kept.slice(at, n).columns, *[pa.array(a, pa.list_(pa.int32())) for a in arrays]], names=[*kept.schema.names, *names])

    schema = StructType([*source.schema.fields[:-1], *[StructField(n, ArrayType(IntegerType())) for n in names]])
    return source.mapInArrow(run, schema)


def longest_fit(path: str, limit: int, before: str, between: str, after: str, spare: int = 8) -> Callable[[Column, Column, Column], Column]:
    """Column function of context, question and answer: how much of the context a prompt of at most ``limit - spare`` tokens holds.

    The prompt is before, context, between, question, after, answer. Tokens at its seams may merge, so its length is not
    the sum of its parts' lengths: the room that the parts leave is tried first, then the context gives up as many tokens
    as are too many, until the whole prompt fits, and takes back what still fits, a token at a time. A context is cut at the
    end of a token, and never inside a sign. A prompt that is too long without any context reads none of it.
    """

    def size(context: str, question: str, answer: str) -> int:
        return len(_ids(path)(before + context + between + question + after + answer))

    @pandas_udf(_FIT)
    def run(context: pd.Series, question: pd.Series, answer: pd.Series) -> pd.DataFrame:
        room, out = limit - spare, []
        contexts = [c or "" for c in context]
        for c, q, a, (ids, _, ends) in zip(contexts, question.fillna(""), answer.fillna(""), _encoded(path, contexts), strict=True):
            upto = lambda k, c=c, ends=ends: c[: ends[k - 1]] if k else ""
            n = len(ids)
            held = functools.cache(lambda k, q=q, a=a, upto=upto: size(upto(k), q, a))
            k = max(0, min(n, room - held(0)))
            while k and (over := held(k) - room) > 0:
                k = max(0, k - over)
            while k < n and held(k + 1) <= room:
                k += 1
            out.append((n, k, len(upto(k)), held(k), k < n))
        return pd.DataFrame(out, columns=["n_tokens", "read_tokens", "read_chars", "seq_len", "cut"])

    return run
