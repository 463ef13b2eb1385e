"""Subword places against slices of the text, and the longest context that fits against trying all."""

import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from plumbline.operators import subwords  # noqa: E402

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def texts():
    rng = random.Random(2)
    return ["", "Hello, world!", "naïve café 漢字 🙂🙃 Ωμέγα", "<|endoftext|> is a text", " \n\t x", "🏳️‍🌈" * 5, "a" * 3000] + ["".join(rng.choices("ab é漢🙂.\n <|>", k=rng.randint(1, 60))) for _ in range(60)]


def test_places_are_those_of_the_slices(spark):
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*texts(), None])], "i int, t string")
    for r in rows.select("t", subwords.subword_offsets(PATH)("t").alias("o")).collect():
        text = r.t or ""
        assert r.o.ids == t.encode(text, add_special_tokens=False).ids
        at = 0
        for k, (i, a, b) in enumerate(zip(r.o.ids, r.o.starts, r.o.ends)):
            assert 0 <= a < b <= len(text)
            piece = t.decode([i], skip_special_tokens=False)
            if "�" not in piece:  # a whole number of signs
                assert text[a:b] == piece and (k == 0 or r.o.ends[k - 1] <= a)
            assert a <= at <= b  # nothing between tokens is left out
            at = b
        assert at == len(text)
        # tokens that share the bytes of one sign have it together, and together they are that sign
        for k in range(len(r.o.ids)):
            z = k + 1
            while z < len(r.o.ids) and r.o.starts[z] < r.o.ends[z - 1]:
                z += 1
            if k == 0 or r.o.starts[k] >= r.o.ends[k - 1]:
                assert text[r.o.starts[k] : r.o.ends[z - 1]] == t.decode(r.o.ids[k:z], skip_special_tokens=False)


@pytest.mark.parametrize("limit", [8, 12, 20, 40])
def test_longest_fit_like_trying_all(spark, limit):
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    count = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    asked = [(x, q, a) for x in texts()[:40] for q, a in (("who?", "me"), ("", ""))] + [(None, None, None)]
    fit = subwords.longest_fit(PATH, limit, "C:", " Q:", " A:", spare=2)
    found = spark.createDataFrame(asked, "c string, q string, a string").select("c", "q", "a", fit("c", "q", "a").alias("f")).collect()
    for r in found:
        c, q, a = r.c or "", r.q or "", r.a or ""
        ((ids, _, ends),) = subwords._encoded(PATH, [c])
        sizes = [count(f"C:{c[: ends[k - 1]] if k else ''} Q:{q} A:{a}") for k in range(len(ids) + 1)]
        assert (r.f.n_tokens, r.f.cut) == (len(ids), r.f.read_tokens < len(ids)) and r.f.seq_len == sizes[r.f.read_tokens]
        fits = [k for k, s in enumerate(sizes) if s <= limit - 2]
        if fits:
            # what it reads fits, and one token more does not
            assert r.f.read_tokens in fits and (r.f.read_tokens == len(ids) or sizes[r.f.read_tokens + 1] > limit - 2)
        else:
            assert r.f.read_tokens == 0


def test_words_are_cut_as_the_library_cuts_texts():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    signs = [chr(c) for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF]
    # by blocks of old and of new signs, which the two may class in different ways
    asked = texts() + ["".join(f"a{c}1{c}  {c}{c}b!{c}\n" for c in signs[i : i + 512]) for i in range(0, len(signs), 512)] + ["x" * 200_000]
    for text, (ids, starts, ends) in zip(asked, subwords._encoded(PATH, asked), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids and len(starts) == len(ends) == len(ids)


@pytest.mark.parametrize("change", [{"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"normalizer": {"type": "Lowercase"}}])
def test_other_files_take_texts_whole(tmp_path, change):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f) | change
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    t = tokenizers.Tokenizer.from_file(str(path))
    t.encode_special_tokens = True
    for text in ["Hello World", " a", "ÀB don't", ""]:
        assert subwords._ids(str(path))(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_memory_follows_texts_not_batches(spark):
    import numpy as np
    import pandas as pd

    # one batch of 24 MB has ten million tokens; the result comes in pieces, each of few texts
    batch = pd.Series([None, "", *["a b c d e f " * 1_000] * 2_000])
    sizes = [len(d) for d in subwords.subword_offsets(PATH).func(iter([batch]))]
    assert sum(sizes) == len(batch) and max(sizes) < 100
    assert list(subwords._pieces(np.array([2, 0, 9, 0, 1]), 4)) == [(0, 2), (2, 2), (4, 1)]
    rows = spark.range(0, 3_000, 1, 1).selectExpr("id", "repeat(concat(id, ' word '), 200) as t")
    found = rows.select("id", subwords.subword_offsets(PATH)("t").alias("o")).selectExpr("id", "size(o.ids) as n", "element_at(o.ends, -1) = length(repeat(concat(id, ' word '), 200)) as whole")
    assert found.where("whole and n > 0").count() == 3_000


def test_subwords_in_sentences_like_the_columns_one_by_one(spark):
    from plumbline.operators.intervals import held_points, sentence_places

    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*texts(), None, "One. Two!\nThree"])], "i int, t string")
    got = {r.i: r for r in subwords.subwords_in_sentences(rows, PATH, "t", ("i",)).collect()}
    apart = rows.select("i", subwords.subword_offsets(PATH)("t").alias("o"), sentence_places("t").alias("s")).select("i", "o", held_points("o.starts", "s.starts", "s.ends").alias("r"))
    want = apart.collect()
    assert len(got) == len(want)
    for w in want:
        r = got[w.i]
        assert (r.starts, r.ends, r.lo, r.hi) == (w.o.starts, w.o.ends, w.r.lo, w.r.hi)
    # one Python worker a task, however many columns
    plan = subwords.subwords_in_sentences(rows, PATH, "t", ("i",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    assert subwords.subwords_in_sentences(rows.where("false"), PATH, "t", ("i",)).count() == 0


def test_a_fit_encodes_each_prompt_once(monkeypatch):
    import pandas as pd

    asked = []
    real = subwords._ids(PATH)
    monkeypatch.setattr(subwords, "_ids", lambda path: lambda text: asked.append(text) or real(text))
    text = "one two three four five six seven " * 100
    fit = subwords.longest_fit(PATH, 40, "C:", " Q:", " A:", spare=2).func
    (got,) = fit(pd.Series([text]), pd.Series(["q"]), pd.Series(["a"])).itertuples(index=False)
    assert got.cut and got.seq_len <= 38 and len(asked) == len(set(asked))


def test_other_tokenizers_are_refused():
    import numpy as np

    with pytest.raises(ValueError, match="byte-level"):
        subwords.byte_places("abc", np.array([1, 1]))
