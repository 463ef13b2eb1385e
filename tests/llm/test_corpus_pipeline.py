"""The pipeline's stages against plain decisions, stage by stage, and on an empty table."""

import collections
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from plumbline.llm.text import materialise
from tests.llm.test_llm_operators import SCHEMA, documents, plain_components, plain_templates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    made = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made.append(materialise(stage(spark, made[-1], "")))
    return made


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    assert stages[-1].columns == ["doc_id", "lang", "source", "n_tokens", "ids"]


def test_language_rejects_what_has_no_letters(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    texts = {r.doc_id: r.text for r in stages[0].collect()}
    assert all(any(c.isalpha() for c in texts[i]) for i in kept)
    assert {0, 1, 2}.isdisjoint(kept) and len(kept) >= 0.8 * len(texts)


def test_lines(stages):
    before = [(r.doc_id, r.text) for r in stages[1].where("doc_id is not null").collect()]
    want = sorted((d, t) for d, n, t in plain_templates(before) if n == 0 or WORD.search(t))
    assert sorted((r.doc_id, r.text) for r in stages[2].where("doc_id is not null").collect()) == want


def test_one_of_each_group(stages):
    before = [(r.doc_id, r.text) for r in stages[2].collect()]
    roots, _ = plain_components(before, 5, 80)
    after = [r.doc_id for r in stages[3].collect()]
    assert sorted(i for i in after if i is not None) == sorted(set(roots.values())) and after.count(None) == sum(i is None for i, _ in before)


def test_mix_takes_at_most_twice(stages):
    sizes, taken = collections.Counter(), collections.Counter()
    for r in stages[3].collect():
        sizes[r.doc_id] += len(WORD.findall(r.text or ""))
    for r in stages[4].collect():
        assert r.n_chars == len(r.text)
        taken[r.doc_id] += len(WORD.findall(r.text))
    assert all(taken[i] <= 2 * sizes[i] for i in taken) and abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 0.1 * sum(sizes.values()) + 200


def test_tokens(stages):
    assert stages[5].count() == stages[4].count()
    assert all(r.n_tokens * 4 == len(r.ids) for r in stages[5].collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""))
    assert docs.count() == 0


def test_clashing_column_names(spark):
    """Names that the stages use inside, names with dots, and repeated rows go through all stages."""
    names = ("others", "rest", "place", "_n", "_", "keep_text", "k1", "h", "size", "score", "lang_pred", "a.b", "x y")
    rng_rows = [(*r, *(f"{n}{r[0]}" for n in names)) for r in documents()]
    docs = spark.createDataFrame(rng_rows, SCHEMA.split(", score")[0] + ", q string, w string, e string, r string, " + ", ".join(f"`{n}` string" for n in names))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = materialise(stage(spark, now, ""))
        assert now.columns == docs.columns
        for r in now.where("doc_id is not null").limit(50).collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() == now.count() > 0


def test_one_short_row_per_task(spark):
    rows = [(i, " ".join(["word"] * (i % 4)) or None, "aa", "s", 0) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(12)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, "")).repartition(5)
    assert docs.count() >= 1


def test_run_leaves_one_stage_behind(spark, tmp_path):
    import os

    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(os.listdir(base))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert len(set(os.listdir(base)) - before) == 1
