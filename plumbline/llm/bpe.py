"""Byte-level BPE encoding and decoding with a given public vocabulary.

A text is cut at the special tokens, then into words by the vocabulary's pattern. For each short word the encoder holds
its part boundaries in one contiguous list and, beside it, the rank of merging each pair of adjacent parts; it scans for
the smallest rank, deletes that boundary, and refreshes the two neighbouring ranks. Words longer than ``SHORT`` bytes
take the same merges from a heap, so a run of a million letters costs n log n. Encoded words are kept in a bounded
per-process memo, which changes no result.

Defined results: a null text is the empty text, with no tokens; repeated rows each get their own row;
of pairs of equal rank the leftmost merges first; an empty table gives no rows; a text of any length is encoded whole;
extra columns are ignored unless passed through ``keep``.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import schema_with

#: The pre-tokenisation of the public byte-level vocabulary: contractions, words, numbers, other signs, white space.
#: Letters come first here, as no other alternative can start where they do, and runs are possessive.
PATTERN = r" ?\p{L}++| ?\p{N}++|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
SHORT = 200
MEMO = 800_000
NONE = 1 << 62


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """Encoded words as little-endian 32-bit ids."""

    def __init__(self, encoder: BytePairEncoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        ids = self.encoder.merge(word.encode())
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            self[word] = found
        return found


class BytePairEncoder:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_chars()
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.token: dict[int, bytes] = {i: raw(t) for t, i in spec["model"]["vocab"].items()}
        self.ids = {b: i for i, b in self.token.items()}
        #: Merged bytes to rank and length of the left part: a pair merges only as the vocabulary lists it.
        self.rank: dict[bytes, int] = {}
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            a, b = raw(left), raw(right)
            self.rank[a + b] = rank << 16 | len(a)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.memo = Memo(self)
        self.bytes_of = [self.token.get(i, b"") for i in range(max(self.token) + 1)]

    def merge(self, word: bytes) -> list[int]:
        if word in self.ids and len(word) == 1:
            return [self.ids[word]]
        return self._scan(word) if len(word) <= SHORT else self._heap(word)

    def _scan(self, word: bytes) -> list[int]:
        rank = self.rank.get
        n = len(word)
        bounds = list(range(n + 1))
        ranks = [v if (v := rank(word[i : i + 2], NONE)) & 0xFFFF == 1 else NONE for i in range(n - 1)]
        while ranks:
            least = min(ranks)
            if least >= NONE:
                break
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            start, middle = bounds[i], bounds[i + 1]
            if i < len(ranks):
                v = rank(word[start : bounds[i + 2]], NONE)
                ranks[i] = v if v & 0xFFFF == middle - start else NONE
            if i:
                before = bounds[i - 1]
                v = rank(word[before:middle], NONE)
                ranks[i - 1] = v if v & 0xFFFF == start - before else NONE
        ids = self.ids
        return [ids[word[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _heap(self, word: bytes) -> list[int]:
        """The same merges for long words: the smallest rank comes from a heap, boundaries are a linked list."""
        rank, n = self.rank.get, len(word)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        alive = bytearray([1]) * (n + 1)

        def pair(start: int) -> tuple[int, int, int] | None:
            middle = after[start]
            if middle >= n:
                return None
            end = after[middle]
            if end - start > 0xFFFF:
                return None
            v = rank(word[start:end], NONE)
            return (v >> 16, start, end) if v < NONE and v & 0xFFFF == middle - start else None

        heap = [p for i in range(n - 1) if (p := pair(i))]
        heapq.heapify(heap)
        while heap:
            now = heapq.heappop(heap)
            start = now[1]
            if not alive[start] or pair(start) != now:
                continue
            middle = after[start]
            alive[middle] = 0
            after[start] = after[middle]
            if after[start] <= n:
                before[after[start]] = start
            for at in (before[start], start):
                if at >= 0 and (p := pair(at)):
                    heapq.heappush(heap, p)
        out, at = [], 0
        while at < n:
            out.append(self.ids[word[at : after[at]]])
            at = after[at]
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(self.memo.__getitem__, self.find(text)))
        parts = []
        for part in self.cut.split(text):
            parts.append(self.special[part].to_bytes(4, "little") if part in self.special else b"".join(map(self.memo.__getitem__, self.find(part))))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", errors="replace")


_encoders: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    if path not in _encoders:
        _encoders[path] = BytePairEncoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the ``keep`` columns, ``n_tokens``, ``ids`` (little-endian 32-bit integers) and ``decoded``.

    ``path`` names the vocabulary file; it lies at the same place on every executor, as the installed library does.
    """
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = source.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids = [coder.encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                columns = [*batch.columns[:-1], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_tokens", "ids", "decoded"])

    return source.mapInArrow(run, schema_with(fields, "n_tokens bigint, ids binary, decoded string"))
