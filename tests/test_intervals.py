"""Places and interval joins against plain loops."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import intervals
from plumbline.plans import spans, windows

TEXTS = ["Aa bb cc. Dd ee ff.", "...Start! Then?? no\n\nend", None, "", "\n.!?", "é漢🙂 one. 🙂 two", "no stop", "a.b.c", "x" * 50 + ".\n" * 40 + "tail. "]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    texts = TEXTS + ["".join(rng.choices("ab .!?\n\té🙂", k=rng.randint(0, 300))) for _ in range(60)]
    return spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").repartition(3)


def places(text):
    return [m.span() for m in re.finditer(r"[^.!?\n]+[.!?]*", text or "")]


def starts(text):
    return [m.start() for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text or "")]


def test_sentence_places(docs):
    for r in docs.select("text", intervals.sentence_places("text").alias("s")).collect():
        assert list(zip(r.s.starts, r.s.ends)) == places(r.text)


def test_tokens_of_sentences(spark, docs, monkeypatch):
    for module in (spans, windows):
        monkeypatch.setattr(module, "table", lambda *_: docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {(d, k): [i for i, p in enumerate(starts(t)) if a <= p < b] for d, t in texts.items() for k, (a, b) in enumerate(places(t))}
    got = {(r.doc_id, r.sent): (r.n_tok, r.first, r.last) for r in spans.sentence_tokens(spark, "").collect()}
    assert got == {k: (len(v), v[0], v[-1]) for k, v in want.items() if len(v) >= 3}
    c = spans.span_coverage_check(spark, "").first()
    assert c.in_none == c.in_several == 0 and c.in_one + c.stops == c.n_tokens == sum(len(starts(t)) for t in texts.values())
    assert c.in_one == sum(map(len, want.values())) and c.empty_spans == sum(not v for v in want.values()) and c.n_spans == len(want)
    probs = {(d, k): max((p * 37 % 101 / 100 for p in range(0, len(texts[d] or ""), 50) if a <= p < b), default=None) for d in texts for k, (a, b) in enumerate(places(texts[d]))}
    assert {(r.doc_id, r.k): r.score for r in windows.checker_scores(spark, "").collect()} == pytest.approx(probs)
    marks = [(d, k, [i for i in range(len(texts[d] or "") // 300 + 1) if i * 300 + 120 > a and i * 300 < b]) for d in texts for k, (a, b) in enumerate(places(texts[d]))]
    assert {(r.doc_id, r.k): (r.n_met, r.bad) for r in windows.span_overlap_labels(spark, "").collect()} == {(d, k): (len(m), any(i % 3 == 0 for i in m)) for d, k, m in marks if m}


def test_a_text_of_a_million_tokens(spark, monkeypatch):
    whole = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word next. "), 500_000).alias("text"))
    monkeypatch.setattr(spans, "table", lambda *_: whole)
    c = spans.span_coverage_check(spark, "").first()
    assert (c.n_tokens, c.in_one, c.in_none, c.n_spans, c.empty_spans) == (1_000_000, 1_000_000, 0, 500_001, 1)


def test_overlapping_spans_hold_points_together(spark):
    df = spark.createDataFrame([([0, 3, 3, 8], [2, 0, 5, 9, 3], [4, 9, 5, 12, 3])], "p array<int>, a array<int>, b array<int>")
    r = df.select("p", intervals.held_points("p", "a", "b").alias("r")).select("r.*", intervals.times_held("p", "r.lo", "r.hi").alias("n")).first()
    assert [b - a for a, b in zip(r.lo, r.hi)] == [2, 4, 0, 0, 0] and r.n == [1, 2, 2, 1]
    bad = df.select(intervals.met_spans("a", "b", "a", "b"))
    with pytest.raises(Exception, match="sorted and apart"):
        bad.collect()


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_binned_joins(spark, width):
    rng = np.random.default_rng(3)
    a = [(int(k), int(s), int(s + n)) for k, s, n in zip(rng.integers(0, 3, 60), rng.integers(0, 90, 60), rng.integers(0, 30, 60))]
    b = [(int(k), int(s), int(s + n)) for k, s, n in zip(rng.integers(0, 3, 60), rng.integers(0, 90, 60), rng.integers(0, 30, 60))]
    want = sorted((*x, *y[1:]) for x in a for y in b if x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and y[2] > x[1] and y[1] < x[2])
    left, right = spark.createDataFrame(a, "k int, a_start int, a_end int"), spark.createDataFrame(b, "k int, b_start int, b_end int")
    got = intervals.overlapping(left, right, "k", width).select("k", "a_start", "a_end", "b_start", "b_end").collect()
    assert sorted(map(tuple, got)) == want
    points = left.select("k", F.col("a_start").alias("p"))
    held = intervals.points_in_spans(points, right, "k", "p", "b_start", "b_end", width).select("k", "p", "b_start", "b_end").collect()
    assert sorted(map(tuple, held)) == sorted((x[0], x[1], *y[1:]) for x in a for y in b if x[0] == y[0] and y[1] <= x[1] < y[2])
