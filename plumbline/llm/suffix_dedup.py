"""Exact substring deduplication by suffix arrays.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else, judged on the input.

1. Anchors. In each window of ``length`` bytes the ``anchor``-byte gram with the smallest hash (the leftmost of equals)
   anchors the window, so equal windows have equal anchors at equal offsets. Anchors that occur once in the whole corpus
   rule out their windows; only the others go on. Windows of one text with one anchor form a run.
2. Shards. Runs meet by anchor. Equal runs collapse first (before the shuffle as well), so a passage that a third of all
   documents share is a row per task. An anchor with many different runs is split into several shards by hash.
3. Per shard, the suffix array of its runs is built in numpy by Larsson-Sadakane refinement: suffixes are sorted by eight
   bytes, then only groups that are still tied are sorted again by the ranks of the suffixes h bytes on, h doubling.
   Kasai common prefixes, computed in strides with the bound PLCP[i] >= PLCP[i - 1] - 1, tell which neighbouring
   suffixes share ``length`` bytes.
4. Shards of one split anchor are merged by binary search: each sends its sorted window keys, cut into key ranges, and
   the keys of every shard are looked up in the sorted keys of the others.

Texts enter as UTF-8 bytes. A document that occurs twice is covered whole if it has ``length`` bytes; only one of its
copies takes part in the search.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; repeated rows are copies of each
other; matches never cross documents; rows with null or equal ids are documents like others, each with its own row; a text of any
length takes part whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.hashing import mix, powers
from plumbline.llm.text import materialise, schema_with

LENGTH, ANCHOR = 400, 128
SHARD_RUNS, CHUNK = 4_000, 2 << 20
_INVERSE = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_rng = np.random.default_rng(90210)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_inverses = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        steps = np.full(max(n, 4096), np.uint64(_INVERSE), np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _inverses = np.cumprod(steps, dtype=np.uint64)
    return _inverses[:n]


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each ``size``-byte gram of the bytes, by prefix sums of a polynomial modulo 2**64."""
    n = len(raw)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[raw] * powers(n), out=sums[1:])
        return mix((sums[size:] - sums[:-size]) * _inverse_powers(n - size + 1))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over x[i : i + width], by doubling."""
    done, out = 1, x
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


PLACE, BLOCK = 28, 1 << 27


def runs(raw: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): runs of consecutive windows with one anchor, in order; ``last`` is the last window's start.

    The anchor is the place of the smallest (upper hash bits, place), so equal windows agree whatever their offset. Texts
    beyond ``BLOCK`` windows go in blocks; that a run is cut there changes no match.
    """
    parts = []
    for begin in range(0, len(raw) - length + 1, BLOCK):
        h = gram_hashes(raw[begin : begin + BLOCK + length - 1], anchor)
        packed = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
        place = (_sliding_min(packed, length - anchor + 1) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        parts.append((h[place[first]].view(np.int64), first + begin, last + begin))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def suffix_array(raw: np.ndarray) -> np.ndarray:
    """All suffixes in order (complete: the bound of the common prefixes rests on it)."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    ordered = key[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    tied = _tied(new)
    while len(tied):
        at = order[tied]
        first = rank[at]
        second = np.where(at + h < n, rank[np.minimum(at + h, n)], n - 1 - at - h)  # over the end: the shorter first
        by = np.argsort(first * (n + h + 2) + second + h + 1, kind="stable")
        at, first, second = at[by], first[by], second[by]
        order[tied] = at
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[_tied(new)]
        h *= 2
    return order


def _tied(new: np.ndarray) -> np.ndarray:
    """Indices in groups of more than one; ``new`` marks the first of each group."""
    alone = new & np.append(new[1:], True)
    return np.flatnonzero(~alone)


def common_prefixes(raw: np.ndarray, order: np.ndarray, limit: int, stride: int = 64) -> np.ndarray:
    """For each place of the suffix array the common prefix with the place before it, up to ``limit`` (place 0: 0)."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(limit + 8, np.uint8)])
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    plcp = np.zeros(n, np.int32)
    for t in range(stride):
        at = np.arange(t, n, stride)
        if not len(at):
            break
        length = np.maximum(plcp[at - 1] - 1, 0) if t else np.zeros(len(at), np.int32)
        other = before[at]
        length[other < 0] = 0
        live = np.flatnonzero((other >= 0) & (length < limit))
        while len(live):
            i, j, m = at[live], other[live], length[live]
            same = (padded[i + m] == padded[j + m]) & (np.maximum(i, j) + m < n)
            live = live[same]
            length[live] += 1
            live = live[length[live] < limit]
            if len(live) > 64 and t == 0:  # long steps while nothing bounds the prefix from below
                live = _leap(padded, at, other, length, live, limit, n)
        plcp[at] = length
    return plcp[order]


def _leap(padded: np.ndarray, at: np.ndarray, other: np.ndarray, length: np.ndarray, live: np.ndarray, limit: int, n: int) -> np.ndarray:
    """Extend by 16 bytes at a time while they agree."""
    lanes = np.arange(16)
    go = live
    while len(go):
        go = go[length[go] + 16 <= limit]
        i, j, m = at[go], other[go], length[go]
        inside = np.maximum(i, j) + m + 16 <= n
        go, i, j, m = go[inside], i[inside], j[inside], m[inside]
        if not len(go):
            break
        agree = (padded[(i + m)[:, None] + lanes] == padded[(j + m)[:, None] + lanes]).all(1)
        go = go[agree]
        length[go] += 16
    return live[length[live] < limit]


def repeated_windows(contents: list[bytes], length: int) -> list[np.ndarray]:
    """Per content a mask over its window starts: True where the window also starts elsewhere among the contents."""
    raw = np.frombuffer(b"".join(contents), np.uint8)
    sizes = np.array([len(c) for c in contents])
    ends = np.cumsum(sizes)
    valid = np.zeros(len(raw), bool)
    for e, s in zip(ends.tolist(), sizes.tolist(), strict=True):
        valid[e - s : e - length + 1] = True
    order = suffix_array(raw)
    lcp = common_prefixes(raw, order, length)
    group = np.cumsum(lcp < length) - 1  # suffixes that share their first bytes
    counts = np.bincount(group[valid[order]], minlength=group[-1] + 1)
    hit = np.zeros(len(raw), bool)
    hit[order] = counts[group] > 1
    hit &= valid
    return [hit[e - s : e - length + 1] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _intervals(mask: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"a": a, "b": b} for a, b in edge.reshape(-1, 2).tolist()]


INTERVALS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _anchors(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """(hash, t, m) of rows (t, text): the anchors of each text, m 2 where it has one twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(text) < length:
                    continue
                h, n = np.unique(runs(np.frombuffer(text, np.uint8), length, anchor)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), t, np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["hash", "t", "m"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gather(run(batches))

    return texts.mapInArrow(joined, "hash bigint, t bigint, m int")


def _gather(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Small batches put together."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows or len(held) >= 2_000:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _candidate_runs(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """(hash, ch, content, t, u, starts) of rows (t, u, text, hashes): the runs of each text whose anchors occur elsewhere; equal runs of a text are one row."""
    names = ["hash", "ch", "content", "t", "u", "starts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, u, text, wanted in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                h, first, last = runs(np.frombuffer(text, np.uint8), length, anchor)
                some = np.isin(h, np.array(wanted, np.int64))
                found: dict[tuple[int, bytes], list[int]] = {}
                for x, a, b in zip(h[some].tolist(), first[some].tolist(), last[some].tolist(), strict=True):
                    found.setdefault((x, text[a : b + length]), []).append(a)
                if found:
                    keys, starts = list(found), list(found.values())
                    contents = [c for _, c in keys]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x for x, _ in keys], pa.int64()), pa.array([_digest(c) for c in contents], pa.int64()), pa.array(contents, pa.binary()), pa.array([t] * len(keys), pa.int64()), pa.array([u] * len(keys), pa.int64()), pa.array(starts, pa.list_(pa.int32()))],
                        names=names,
                    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gather(run(batches), 4_000)

    return texts.mapInArrow(joined, "hash bigint, ch bigint, content binary, t bigint, u bigint, starts array<int>")


def _digest(content: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(content) - (1 << 63)


def _shard_matches(shards: DataFrame, length: int) -> DataFrame:
    """(hash, ch, spans) of rows (hash, sub, ch, content), sorted by (hash, sub): window starts that are repeated inside a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[int] = []
        chs: list[int] = []
        contents: list[bytes] = []
        size, now = 0, None

        def solved() -> pa.RecordBatch:
            spans = [_intervals(m) for m in repeated_windows(contents, length)]
            return pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(chs, pa.int64()), pa.array(spans, INTERVALS)], names=["hash", "ch", "spans"])

        for batch in batches:
            for x, sub, ch, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size >= CHUNK and (x, sub) != now:  # a chunk ends where a shard ends
                    yield solved()
                    hashes, chs, contents, size = [], [], [], 0
                now = x, sub
                hashes.append(x)
                chs.append(ch)
                contents.append(content)
                size += len(content)
        if contents:
            yield solved()

    return shards.mapInArrow(run, "hash bigint, ch bigint, spans array<struct<a:int,b:int>>")


def _merged_matches(split: DataFrame, length: int) -> DataFrame:
    """(hash, ch, spans) of rows (hash, sub, n_subs, ch, content): windows of split anchors that other shards have too."""
    schema = "hash bigint, part int, sub int, key bigint, ch bigint, at int"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, sub, n, ch, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                k = gram_hashes(np.frombuffer(content, np.uint8), length)
                part = ((k >> np.uint64(33)).astype(np.int64) % n).astype(np.int32)
                m = len(k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, x, np.int64)), pa.array(part), pa.array(np.full(m, sub, np.int32)), pa.array(k.view(np.int64)), pa.array(np.full(m, ch, np.int64)), pa.array(np.arange(m, dtype=np.int32))], names=["hash", "part", "sub", "key", "ch", "at"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gather(keys(batches))

    def look_up(rows: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(len(rows), bool)
        key, sub = rows["key"].to_numpy(), rows["sub"].to_numpy()
        sides = {s: np.unique(key[sub == s]) for s in np.unique(sub)}
        for s, own in sides.items():
            for other, there in sides.items():
                if other != s and len(there):
                    at = np.minimum(np.searchsorted(there, own), len(there) - 1)
                    hit = own[there[at] == own]
                    found |= (sub == s) & np.isin(key, hit)
        return rows.loc[found, ["hash", "ch", "at"]]

    hits = split.mapInArrow(joined, schema).groupBy("hash", "part").applyInPandas(look_up, "hash bigint, ch bigint, at int")
    return hits.groupBy("hash", "ch").agg(F.transform(F.collect_set("at"), lambda x: F.struct(x.alias("a"), (x + 1).alias("b"))).alias("spans"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the ``keep`` columns, n_bytes, spans (maximal runs of removed bytes) and kept (the remaining bytes)."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(*keep, raw.alias("text")).withColumns({"t": F.xxhash64("text"), "u": F.xxhash64(F.lit(1), "text")})
    long_ = rows.where(F.octet_length("text") >= length)

    found = materialise(_anchors(long_.select("t", "text"), length, anchor))
    often = found.groupBy("hash").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.max("m").alias("m")).where("lo <> hi or m > 1").select("hash")
    wanted = found.select("hash", "t").distinct().join(often, "hash").groupBy("t").agg(F.collect_set("hash").alias("hashes"))
    copies = long_.select("t", "u", F.col(doc_id).alias("_id")).groupBy("t", "u").agg(F.count(F.lit(1)).alias("copies"), F.min("_id").alias("_first"))
    picked = copies.join(wanted, "t").select("t", "u", "_first", "hashes").hint("shuffle_hash")
    ones = docs.select(F.col(doc_id).alias("_first"), raw.alias("text")).where(F.octet_length("text") >= length).withColumns({"t": F.xxhash64("text"), "u": F.xxhash64(F.lit(1), "text")})
    sources = ones.join(picked.withColumnRenamed("_first", "_f"), ["t", "u"]).where(F.col("_first").eqNullSafe(F.col("_f")))
    inst = materialise(_candidate_runs(sources.select("t", "u", "text", "hashes"), length, anchor), "zstd")

    grouped = inst.groupBy("hash", "ch").agg(F.first("content").alias("content"), F.sum(F.size("starts")).alias("places"))
    grouped = materialise(grouped, "zstd")
    split = grouped.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("n_subs", F.ceil(F.col("n") / SHARD_RUNS).cast("int"))
    shards = grouped.select("hash", "ch", "content").join(split.drop("n"), "hash").withColumn("sub", F.pmod("ch", F.col("n_subs")).cast("int"))
    inside = _shard_matches(shards.select("hash", "sub", "ch", "content").repartition("hash", "sub").sortWithinPartitions("hash", "sub"), length)
    across = _merged_matches(shards.where("n_subs > 1").select("hash", "sub", "n_subs", "ch", "content"), length)
    whole = grouped.where("places > 1").select("hash", "ch", F.array(F.struct(F.lit(0).alias("a"), (F.length("content") - (length - 1)).cast("int").alias("b"))).alias("spans"))
    matches = inside.unionByName(across).unionByName(whole).where(F.size("spans") > 0)

    places = inst.select("hash", "ch", "t", "u", F.explode("starts").alias("s")).join(matches, ["hash", "ch"])
    cover = places.select("t", "u", F.explode(F.transform("spans", lambda x: F.struct((F.col("s") + x["a"]).alias("a"), (F.col("s") + x["b"]).alias("b")))).alias("x"))
    spans = cover.groupBy("t", "u").agg(F.collect_set("x").alias("found"))
    told = copies.select("t", "u", "copies").join(spans, ["t", "u"], "left").where("copies > 1 or found is not null")
    final = rows.join(told.hint("shuffle_hash"), ["t", "u"], "left").select(*keep, "copies", "found", "text")
    fields = final.schema.fields[: len(keep)]
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 500):
                batch = whole_batch.slice(at, 500)
                sizes, spans_, kept = [], [], []
                for n_copies, some, t in zip(*[c.to_pylist() for c in batch.columns[-3:]], strict=True):
                    merged: list[list[int]] = [[0, len(t)]] if (n_copies or 0) > 1 else []
                    if not merged:
                        for a, b in sorted((x["a"], x["b"] - 1 + length) for x in some or []):
                            if merged and a <= merged[-1][1]:
                                merged[-1][1] = max(merged[-1][1], b)
                            else:
                                merged.append([a, b])
                    edges = [0, *(x for m in merged for x in m), len(t)]
                    sizes.append(len(t))
                    spans_.append([{"begin": a, "end": b} for a, b in merged])
                    kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(sizes, pa.int64()), pa.array(spans_, kind), pa.array(kept, pa.binary())], names=[*batch.schema.names[:-3], "n_bytes", "spans", "kept"])

    return final.mapInArrow(cut, schema_with(fields, "n_bytes bigint, spans array<struct<begin:int,end:int>>, kept binary"))
