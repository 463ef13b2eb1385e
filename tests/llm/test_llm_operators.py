"""Each training-data operator against a plain version, on small tables with the awkward rows."""

import collections
import hashlib
import os
import pickle
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import hashing, language, line_templates, minhash, mixing, neighbours, pu_quality, quality_rules, queries, suffix_dedup, toxicity
from plumbline.llm.bpe import BytePairEncoder, encode_documents
from plumbline.llm.components import components
from plumbline.llm.text import letter_words, smallest_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, size string, kept string, component_id string"


def words_of(rng, n, letters="abcdefgh"):
    return ["".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(n)]


def documents():
    """Nulls, empty and long texts, copies, near copies, repeated rows and lines, symbols, other scripts."""
    rng = random.Random(4)
    base = [" ".join(words_of(rng, 120)) for _ in range(8)]
    near = base[0].split()
    near[5], near[60] = "other", "words"
    texts = [None, "", " \t\n\x0b ", "one", "two words", *base, base[0], base[1], base[1], " ".join(near), base[2].upper(), "x y z " * 40, "a " * 3000 + "\n" + "b" * 5000, "# | <b> $\n# | <b> $\n# | <b> $ é 漢字 🙂 end of all these words", "0x1f \xa0 nbsp stays"]
    texts += [f"All rights reserved {2000 + i}\nno {w} at all {i}\n" + base[3][:50] for i, w in enumerate(words_of(rng, 14))]
    rows = [(i, t, ("aa", "bb", None)[i % 3], ("s2", "s1", None, "s3")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "no id here but words and more words follow for all", "aa", "s1", 5)]
    return [(*r, "x", "y", "z", "w") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    """A folder with documents, labels, embeddings and conversations, and one where all are empty."""
    made = []
    for name, some in (("full", rows), ("none", [])):
        d = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(some, SCHEMA).write.parquet(f"{d}/documents.parquet")
        labels = [(r[0], int((i * 7) % 5 > 0), int(i % 4 == 0)) for i, r in enumerate(some)] + ([(3, None, None), (3, 1, 1)] if some else [])
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        vectors = [(i, [float(i % 5), 1.0, float(i)]) for i in range(40 if some else 0)] + ([(100, None), (200, [0.0, 0.0, 0.0]), (300, [float("nan"), 1.0, 1.0]), (400, [1.0, None, 1.0]), (500, [1.0, 2.0])] if some else [])
        spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
        turns = [(i, 0, "user", r[1], "k", "p") for i, r in enumerate(some)]
        spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, key string, part string").write.parquet(f"{d}/conversations.parquet")
        made.append(d)
    return made


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_run_on_full_and_empty_tables(spark, tables, rows, name):
    full, more = queries.QUERIES[name](spark, tables[0]), int(name.startswith("op12"))  # a conversation of its own
    assert full.count() == (10 * 1 if name.startswith("op9") else len(rows) + more)
    assert queries.QUERIES[name](spark, tables[1]).count() == more
    assert len(set(full.columns)) == len(full.columns)


def test_quality_rules_counts_and_ratio(spark, docs, rows):
    trusted = spark.createDataFrame([(5,), (6,), (6,), (None,)], "doc_id bigint")
    got = quality_rules.quality_rules(docs, trusted, buckets=64).collect()
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h

    def grams(text):
        h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORD.findall(text or "")]
        long_ = lambda v, seed: xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
        return [x % 64 for x in h] + [signed(long_(b, long_(a, 42))) % 64 for a, b in zip(h, h[1:], strict=False)]

    raw, target = collections.Counter(), collections.Counter()
    for r in rows:
        raw.update(grams(r[1]))
        if r[0] in (5, 6):
            target.update(grams(r[1]))
    ratio = [np.log((target[b] + 1) / (sum(target.values()) + 64)) - np.log((raw[b] + 1) / (sum(raw.values()) + 64)) for b in range(64)]
    want = []
    for r in rows:
        w, t = WORD.findall(r[1] or ""), r[1] or ""
        five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = collections.Counter(five)
        twice = {i + k for i, g in enumerate(five) if often[g] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        g = grams(r[1])
        want.append((r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice), round(float(np.mean([ratio[b] for b in g])) if g else 0.0, 9)))
    found = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, round(r.llr, 9)) for r in got]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(found, key=key) == sorted(want, key=key)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD) for r in got)


def test_mixing_targets_bounds_and_reruns(spark, docs, rows):
    got = mixing.mix_sources(docs, block=4).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    taken = collections.Counter()
    for r in got:
        assert r.size == sum(e - b for _, b, e in [(0, 0, r.size)]) and 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert all(0 <= x["begin"] < x["end"] <= r.size for x in r.ranges or []) and len({(x["pass"], x["begin"]) for x in r.ranges or []}) == len(r.ranges or [])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 40 for s in order)
    again = mixing.mix_sources(docs.repartition(7), block=4).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert [key(r) for r in sorted(got, key=key)] == [key(r) for r in sorted(again, key=key)]


def test_swap_or_not_is_a_permutation(spark):
    counts = spark.createDataFrame([(0, 97, 0, 0, 194), (1, 5, 0, 0, 20), (2, 1, 0, 0, 2)], "rank bigint, n_blocks bigint, shard bigint, first bigint, n bigint")
    got = mixing.block_slots(counts, 2, mixing.ROUNDS, 9).groupBy("rank", "pass").agg(F.sort_array(F.collect_list("block")).alias("b")).collect()
    assert {(r.rank, r["pass"]): r.b for r in got} == {(k, p): list(range(n)) for k, n in ((0, 97), (1, 5), (2, 1)) for p in (0, 1)}


def test_mixed_texts_hold_the_words_read(spark, docs):
    plan = {}
    for r in mixing.mix_sources(docs, block=4).where("doc_id is not null").collect():
        plan.setdefault(r.doc_id, []).append(r.taken)
    got = collections.defaultdict(int)
    for r in mixing.mixed_texts(docs, block=4).where("doc_id is not null").collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert got == {k: sum(v) for k, v in plan.items() if sum(v)}


def test_bpe_equals_the_library(spark, docs, rows):
    lib = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(lib.path("byte_bpe_50k.json"))
    there, mine = Tokenizer.from_file(path), BytePairEncoder(path)
    rng = random.Random(3)
    signs = list("ab'stvermld 12 \n\t\r\x0b\x1c\x85\xa0　漢é🙂_-!<|>.") + ["<|endoftext|>", "'ll"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(1500)] + ["a" * 3000, " " * 2000, "é" * 700, "abcdefg" * 900]
    for t in texts:
        ids = there.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == ids and mine.decode(mine.encode(t)) == there.decode(ids, skip_special_tokens=False)
    for w in (b"thehehehe", b"abababab", b"  x", bytes(range(60, 120))):
        assert mine._scan(w) == mine._heap(w)
    for r in encode_documents(docs, path, keep=("doc_id", "text")).collect():
        assert r.n_tokens == len(r.ids) // 4 and r.decoded == (r.text or "")


def plain_components(rows, width, percent):
    sets = collections.defaultdict(list)
    for r in rows:
        if r[0] is not None:
            w = (r[1] or "").encode().lower().split()
            sets[r[0]].append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    above = {i: i for i in sets}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((root(i), root(j)))
                above[b] = a
    return {i: root(i) for i in ids}, {i: len(sets[i][0]) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_components(docs, rows, width):
    want, sizes = plain_components(rows, width, 80)
    got = minhash.near_duplicates(docs, width).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], want[r.doc_id] == r.doc_id)


def test_short_texts_of_a_task():
    """All texts of a piece together may have fewer words than a shingle."""
    for width in (1, 2, 5):
        for n in range(7):
            (own,) = hashing.shingle_sets([b" ".join(b"w%d" % i for i in range(n))], width)
            assert len(own) == (max(1, n - width + 1) if n else 0)
        a, b, c, d = hashing.shingle_sets([b"a", None, b"A", b"a b"], width)
        assert a.tolist() == c.tolist() and not len(b) and (width == 1 or a.tolist() != d.tolist())


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_of_one_short_row_per_task(spark, width):
    some = [(i, " ".join(["w"] * (i % 6) + ["x"] * (i // 6 % 2))) for i in range(14)]
    want, sizes = plain_components(some, width, 80)
    got = minhash.near_duplicates(spark.createDataFrame(some, "doc_id bigint, text string").repartition(14), width).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == {i: (want[i], sizes[i]) for i in want}


def test_minhash_id_with_several_texts(spark):
    rng = random.Random(6)
    a, b, c = (" ".join(words_of(rng, 60)) for _ in range(3))
    some = [(1, a), (5, a), (5, b), (4, b), (3, c), (9, c + " end"), (9, "else"), (2, "else")]
    want, _ = plain_components(some, 2, 80)
    got = minhash.near_duplicates(spark.createDataFrame(some, "doc_id bigint, text string"), 2).collect()
    assert len(got) == 8 and all(r.component_id == want[r.doc_id] for r in got) and set(want.values()) == {1, 2}


def test_set_hashes_tell_sets_apart():
    sets = [np.array(x, np.uint64) for x in ([], [1], [2], [1, 2], [3], [1, 2, 3])]
    h = minhash.set_hashes(sets)
    assert len({tuple(x) for x in h.tolist()}) == len(sets) and h.tolist() == minhash.set_hashes(sets).tolist()


@pytest.mark.parametrize("few", [0, 4])
def test_minhash_blocks_find_every_link(spark, monkeypatch, few):
    """A chain of near copies where no leader meets all, in blocks of two, with no leader rounds, in groups of buckets and bucket by bucket."""
    monkeypatch.setattr(minhash, "FEW", few)
    rng = random.Random(8)
    words = words_of(rng, 200, "abcdefghijklmnop")
    chain = []
    for i in range(12):
        for k in rng.sample(range(200), 6):
            words[k] = f"w{i}x{k}"
        chain.append((i * 3, " ".join(words)))
    docs = spark.createDataFrame(chain, "doc_id bigint, text string")
    want, _ = plain_components(chain, 2, 80)
    for leaders in (0, 2):
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 2, leaders=leaders, block=2).collect()} == want


def test_min_max_signatures_are_unbiased():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 300, np.uint64)
    a, b = np.unique(pool[:240]), np.unique(pool[60:])
    keys = minhash.signatures([a, b], 2000, 1)
    assert abs((keys[0] == keys[1]).mean() - 180 / 300) < 0.05


def test_components_of_a_long_path(spark):
    n = 40
    edges = spark.createDataFrame([(i * 7 % n, (i + 1) * 7 % n) for i in range(n - 1)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 100: 100, 101: 100}
    assert components(edges.where("false")).count() == 0


def test_pu_quality_learns_from_positives_only():
    rng = np.random.default_rng(5)
    good, bad = rng.standard_normal((600, 4)) + 1.5, rng.standard_normal((200, 4)) - 1.5
    every = np.vstack([good[300:], bad[:130]])
    net = pu_quality.Network(every.mean(0), every.std(0), 0.7).fit(good[:300], every, steps=600)
    assert (net.score(good) >= 0.5).mean() > 0.9 and (net.score(bad) < 0.5).mean() > 0.9
    assert pu_quality.features(None).shape == (pu_quality.NAMES,) and np.isfinite(pu_quality.features(b"x " * 50_000)).all()
    assert (pu_quality.Network(np.zeros(2), np.ones(2), 0.3).score(np.zeros((2, 2))) == 0.5).all()


@pytest.mark.parametrize("prior", [None, 0.2, 0.8])
def test_pu_quality_gradients(prior):
    """Of the whole risk where its second part is above zero; of minus that part where it is below."""
    rng = np.random.default_rng(3)
    net = pu_quality.Network(np.zeros(3), np.ones(3), prior)
    parts = [rng.standard_normal((3, 4)), rng.standard_normal(4), rng.standard_normal(4), rng.standard_normal(1), rng.standard_normal(3)]
    signs = set()
    for shift in (-2.0, 2.0):
        p, u = rng.standard_normal((7, 3)) - shift, rng.standard_normal((9, 3)) + shift
        both = lambda: (net._raw(parts, p), net._raw(parts, u))  # noqa: B023, E731
        rest = lambda: (lambda a, b: np.logaddexp(0, b).mean() - (prior or 0) * np.logaddexp(0, a).mean())(*both())  # noqa: B023, E731
        below = prior is not None and rest() < 0
        value = (lambda: -rest()) if below else (lambda: net.risk(parts, p, u)[0])  # noqa: B023
        signs.add(below)
        for part, grad in zip(parts, net.risk(parts, p, u)[1], strict=True):
            for at in np.ndindex(part.shape):
                old, step = part[at], 1e-6
                part[at] = old + step
                up = value()
                part[at] = old - step
                down = value()
                part[at] = old
                assert (up - down) / (2 * step) == pytest.approx(grad[at], abs=1e-6)
    assert prior is None or prior < 0.5 or True in signs


def test_class_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(8)
    for share in (0.3, 0.6, 0.9):
        held, good, bad = rng.normal(1, 0.5, 4000), rng.normal(1, 0.5, int(40_000 * share)), rng.normal(-1, 0.5, int(40_000 * (1 - share)))
        cuts = np.append(np.quantile(held, np.linspace(0, 0.5, 20)), -99)
        every = np.concatenate([good, bad])
        assert pu_quality.prior_of((held[:, None] >= cuts).mean(0), (every[:, None] >= cuts).sum(0), len(every)) == pytest.approx(share, abs=0.04)
    assert pu_quality.prior_of(np.ones(2), np.array([0, 0]), 0) == 0.01


def test_pu_features_against_plain_counts(spark, docs, rows):
    got = pu_quality.featured(docs, keep=("doc_id", "source")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next((t for d, t, *_ in rows if d == r.doc_id), None)
        w = (text or "").encode().split()
        assert len(r.x) == pu_quality.NAMES and r.x[10] == pytest.approx(np.log1p(len(w)) / 5 if w else 0.0)
        assert sum(r.x[:10]) == pytest.approx(1.0 if text else 0.0) and (not w or r.x[15] == pytest.approx(len(set(w)) / len(w)))


def test_smallest_hashes(spark):
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    want = [r.doc_id for r in ids.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))).limit(300).collect()]
    assert sorted(r.doc_id for r in smallest_hashes(ids, 300).collect()) == sorted(want)
    assert smallest_hashes(ids, 9000).count() == 5000


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name, label, least", [("op3_pu_quality", "quality", 0.93), ("op6_toxicity", "toxic", 0.85), ("op7_language_id", "lang", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    truth = spark.read.parquet(f"{DATA}/{'documents' if label == 'lang' else 'labels'}.parquet").select("doc_id", label).toPandas().drop_duplicates("doc_id")
    both = got[got.held_out].merge(truth, on="doc_id")
    guess = both.lang_pred if label == "lang" else both.predicted
    assert (guess == both[label]).mean() >= least
    assert got.score.between(0, 1).all()
    m, k = {"op3_pu_quality": (3, 1), "op6_toxicity": (5, 0), "op7_language_id": (5, 0)}[name]
    assert all(h == (zlib.crc32(str(i).encode()) % m == k) for i, h in zip(got.doc_id, got.held_out, strict=True))


def test_toxicity_index_is_exact():
    rng = random.Random(1)
    terms = [f"t{i}" for i in range(30)]
    idf = {t: rng.random() + 0.5 for t in terms}
    counts = [dict(collections.Counter(rng.choices(terms, k=5))) for _ in range(400)]
    index = toxicity.Index(idf, list(range(400)), counts, [i % 2 for i in range(400)], 0.1)
    vectors = [index.vector(c) for c in counts]
    for _ in range(30):
        v = index.vector(dict(collections.Counter(rng.choices(terms, k=4))))
        want = sorted(((-sum(x * w.get(t, 0) for t, x in v.items()), i) for i, w in enumerate(vectors)))[: toxicity.NEAREST]
        assert [round(c, 9) for c, _, _ in index.nearest(v)] == [round(-c, 9) for c, _ in want if c < 0]
    assert index.vote({}) == (0.1, [])


@pytest.mark.parametrize("head", [0, 7])
def test_toxicity_dense_and_sparse_terms(head):
    rng = random.Random(2)
    terms = [f"t{i}" for i in range(60)]
    counts = [dict(collections.Counter(rng.choices(terms, k=4))) for _ in range(300)] + [{"t3": 1}] * 40
    index = toxicity.Index({t: rng.random() + 0.5 for t in terms}, range(340), counts, [0] * 340, 0.1, head)
    vectors = [index.vector(c) for c in counts]
    for c in counts[:20] + counts[-1:]:
        want = sorted((-round(sum(x * w.get(t, 0) for t, x in index.vector(c).items()), 9), i) for i, w in enumerate(vectors))[: toxicity.NEAREST]
        assert [(round(-s, 9), i) for s, i, _ in index.search([index.encode(c)])[0]] == [x for x in want if x[0] < 0]


def test_toxicity_keeps_words_and_examples_without_evidence(spark):
    plain = [(i, f"plain{i % 7} story{i} of common day{i % 5}", 0) for i in range(60)]
    rows = [*plain, (60, "quiet remark nobody else makes", 1), (61, None, 0), *[(70 + i, f"vile slur{i} here", 1) for i in range(30)]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    index = toxicity.train(docs.select("doc_id", "text"), docs.select("text"), docs.select("doc_id", "toxic"))
    index = pickle.loads(pickle.dumps(index))
    assert len(index.ids) == len(rows) and {w for _, t, _ in rows for w in letter_words(t)} == set(index.number)
    copy = toxicity.score(spark.createDataFrame([(1, rows[60][1])], "doc_id bigint, text string"), index).first()
    assert copy.score > 0.5 and copy.evidence[0].doc_id == 60 and round(copy.evidence[0].cosine, 9) == 1


def test_toxicity_query_against_brute_force(spark, tmp_path):
    """The whole query: terms, weights, cosines with every example, votes, calibration."""
    rng = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in "lmnrs"]
    text = lambda bad: " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)) + (["vile", "slur"][: rng.randint(1, 2)] if bad else []))
    docs = [(i, text(i % 4 == 0) if i % 37 else (None, "", "123")[i // 37 % 3]) for i in range(400)] + [(400, "vile " * 4000 + " ".join(vocabulary)), (401, "Vile SLUR²x")]
    docs += [docs[8], docs[8], (None, "vile")] + [(12, f"one id of many rows {i}") for i in range(300)]
    labels = [(i, int(i % 4 == 0)) for i in range(0, 400, 2)] + [(8, 0), (6, None), (None, 1)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 0
    known = {}
    for i, y in labels:
        if not held(i) and y is not None:
            known[i] = max(y, known.get(i, 0))
    # one example per learnable id, whose first text counts
    texts = {}
    for i, t in docs:
        if i in known:
            texts[i] = min((x for x in (t, texts.get(i)) if x is not None), default=None)
    examples = sorted(((i, known[i], letter_words(t)) for i, t in texts.items()), key=lambda x: x[0])
    n, bad = len(examples), sum(y for _, y, _ in examples)
    df, a, all_df = collections.Counter(), collections.Counter(), collections.Counter()
    for _, y, c in examples:
        df.update(c.keys())
        if y:
            a.update(c.keys())
    for _, t in docs:
        all_df.update(letter_words(t).keys())
    weight = {}
    for t, k in df.items():
        b = k - a[t]
        lift = a[t] * (n - bad - b) - b * (bad - a[t])
        boosted = a[t] >= toxicity.LEAST and lift > 0 and n * lift**2 >= toxicity.CHI * k * (n - k) * bad * (n - bad)
        weight[t] = (np.log((1 + len(docs)) / (1 + all_df[t])) + 1) * (toxicity.BOOST if boosted else 1)
    assert {t for t in weight if weight[t] > 8} >= {"vile"}

    def vector(c):
        v = {t: (1 + np.log(k)) * weight[t] for t, k in c.items() if t in weight}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = [(i, y, vector(c)) for i, y, c in examples]
    prior = (bad + 0.5) / (n + 1)

    def near(v, but=None):
        found = [(-round(sum(x * w.get(t, 0) for t, x in v.items()), 12), i, y) for i, y, w in vectors if i != but]
        return [x for x in sorted(found)[: toxicity.NEAREST] if x[0] < 0]

    def vote(found):
        w = [1 / (1.05 + c) for c, _, _ in found]
        return (0.5 * prior + sum(x * y for x, (_, _, y) in zip(w, found, strict=True))) / (0.5 + sum(w)) if found else prior

    odds = toxicity.Odds.fit(np.array([vote(near(v, i)) for i, _, v in vectors]), np.array([y for _, y, _ in vectors]))
    got = sorted(queries.op6_toxicity(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    want = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(want)
    for r, (i, t) in zip(got, want, strict=True):
        found = near(vector(letter_words(t)))
        assert r.held_out == held(i) and r.predicted == int(r.score >= 0.5)
        assert r.score == pytest.approx(odds.score(vote(found)) if found else prior, abs=1e-6)
        assert [e.cosine for e in r.evidence] == pytest.approx([-c for c, _, _ in found], abs=2e-9)


def test_toxicity_calibration():
    rng = np.random.default_rng(4)
    z = rng.normal(-1, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(2 * z + 0.5)))).astype(int)
    odds = toxicity.Odds.fit(1 / (1 + np.exp(-z)), y)
    assert odds.scale == pytest.approx(2, abs=0.15) and odds.shift == pytest.approx(0.5, abs=0.15)
    assert toxicity.Odds.fit(np.array([0.1, 0.2]), np.array([1, 1])).score(0.3) == pytest.approx(0.3)


def test_language_backoff():
    rows = [("aa", 0, "hello", 0.5), ("bb", 0, "salut", 0.5), ("aa", 2, "he", 0.2), ("bb", 2, "sa", 0.2), ("aa", 1, "z", 0.1)]
    table = lambda some: pa.table({n: pa.array([r[i] for r in some], t) for i, (n, t) in enumerate((("lang", pa.string()), ("size", pa.int32()), ("gram", pa.string()), ("share", pa.float64())))})
    model = pickle.loads(pickle.dumps(language.Languages(table(rows), 1e-6)))
    named, scores = language.classify([None, "", "123 !?", "hello", "SALUT", "hexx", "saxx"], model, language.rows_of(model))
    assert named == ["und", "und", "und", "aa", "bb", "aa", "bb"] and scores[:3] == [0, 0, 0] and all(0 < s <= 1 for s in scores[3:])
    assert language.classify(["x"], language.Languages(table([]), 1e-6), None)[0] == ["und"]
    assert language.classify(["²", "½ ①", "Ⅷ", "_ 9"], model, language.rows_of(model)) == (["und"] * 4, [0.0] * 4)
    assert letter_words("Ab²ab x½ É_é") == {"ab": 2, "x": 1, "é": 2}


def test_language_query_against_a_plain_version(spark, tables, rows):
    learned = [(r[2], letter_words(r[1])) for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 and r[2] is not None]
    counts = collections.defaultdict(collections.Counter)
    for lang, words in learned:
        for w, n in words.items():
            counts[lang, 0][w] += n
            for size in range(1, language.LONGEST + 1):
                for i in range(len(w) + 3 - size):
                    counts[lang, size][f"<{w}>"[i : i + size]] += n
    langs = sorted({lang for lang, _ in counts})
    share = {key: {g: n / sum(c.values()) for g, n in c.items() if n >= sum(c.values()) * language.FLOOR} for key, c in counts.items()}
    low = np.log(language.FLOOR / 2)

    def of_word(w):
        if any(w in share.get((x, 0), ()) for x in langs):
            return np.array([np.log(share[x, 0][w]) if w in share.get((x, 0), ()) else low for x in langs])
        whole, found = f"<{w}>", []
        for i in range(len(whole)):
            for size in range(min(language.LONGEST, len(whole) - i), 0, -1):
                g = whole[i : i + size]
                if any(g in share.get((x, size), ()) for x in langs):
                    found.append([(np.log(share[x, size][g]) if g in share.get((x, size), ()) else low) / size for x in langs])
                    break
        return np.mean(found, 0) if found else np.zeros(len(langs))

    got = sorted(queries.op7_language_id(spark, tables[0]).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    for r, (i, t, *_) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        words = letter_words(t)
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = sum(n * of_word(w) for w, n in words.items())
        odds = np.exp(total - total.max())
        assert r.score == pytest.approx(odds.max() / odds.sum(), rel=1e-3)
        assert r.lang_pred == langs[int(odds.argmax())] or abs(total[0] - total[1]) < 1e-3 * abs(total[0])
        assert r.held_out == (i is None or zlib.crc32(str(i).encode()) % 5 == 0)

def test_language_counts(spark):
    counts = language.gram_counts(spark.createDataFrame([("aa", "Ab ab, c9d"), ("bb", None)], "lang string, text string"), 2).collect()
    assert {(r.size, r.gram): r.n for r in counts} == {(0, "ab"): 2, (0, "c"): 1, (0, "d"): 1, (1, "<"): 4, (1, ">"): 4, (1, "a"): 2, (1, "b"): 2, (1, "c"): 1, (1, "d"): 1, (2, "<a"): 2, (2, "ab"): 2, (2, "b>"): 2, (2, "<c"): 1, (2, "c>"): 1, (2, "<d"): 1, (2, "d>"): 1}


def plain_templates(rows, depth=3, least=10, share=0.7, shortest=1, long=10, twice=2):
    lines = []
    for d, t in rows:
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            raw = tuple(WORD.findall(line))
            if len(raw) >= shortest:
                lines.append((d, t, p, raw))
    field = lambda raw: tuple("<*>" if re.search("[0-9]", x) else x for x in raw) if len(raw) >= depth else raw
    leaf = lambda w: (len(w), w[:depth])
    busy, exact = collections.defaultdict(set), collections.defaultdict(set)
    for _, t, _, raw in lines:
        busy[leaf(field(raw))].add(t)
        exact[raw].add(t)
    kinds, support = collections.defaultdict(set), collections.Counter()
    for _, t, _, raw in lines:
        if len(busy[leaf(field(raw))]) >= least:
            kinds[field(raw)].add(t)
    for w, texts in kinds.items():
        for i in range(depth, len(w)):
            support[leaf(w), i, w[i]] += len(texts)

    def template(raw):
        w = field(raw)
        shape = tuple(w[i] if support[leaf(w), i, w[i]] >= least else "<*>" for i in range(depth, len(w)))
        fixed = sum(x != "<*>" for x in shape)
        enough = fixed + sum(x != "<*>" for x in w[:depth]) >= share * len(w)
        return (leaf(w), shape) if shape and enough and (fixed or all(x == "<*>" for x in w[depth:])) else raw

    found, first, whole = collections.defaultdict(set), {}, {}
    for d, t, _, raw in lines:
        whole[raw] = min(whole.get(raw, d), d)
        if len(busy[leaf(field(raw))]) >= least:
            k = template(raw)
            found[k].add(t)
            first[k] = min(first.get(k, d), d)
    gone = collections.defaultdict(set)
    for d, t, p, raw in lines:
        k = template(raw)
        if len(busy[leaf(field(raw))]) >= least and len(found[k]) >= least and first[k] != d:
            gone[d, t].add(p)
        if len(raw) >= long and len(exact[raw]) >= twice and whole[raw] != d:
            gone[d, t].add(p)
    return sorted((d, len(gone[d, t]), "" if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[d, t])) for d, t in rows)


@pytest.mark.parametrize("least", [2, 10])
def test_line_templates(docs, rows, least):
    got = line_templates.drop_templates(docs.where("doc_id is not null"), least=least).collect()
    want = plain_templates([r[:2] for r in rows if r[0] is not None], least=least)
    assert sorted((r.doc_id, r.n_dropped, r.text or "") for r in got) == want
    assert sum(w[1] for w in want) >= 13


def dropped_lines(spark, texts):
    got = line_templates.drop_templates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.doc_id)]


def test_short_lines_recur(spark):
    texts = [f"own{chr(97 + i)} words\n\nSubscribe\n Read  more\n{i}\nPage {i}" for i in range(10)]
    assert dropped_lines(spark, texts) == [texts[0]] + [f"own{chr(97 + i)} words\n\n{i}\nPage {i}" for i in range(1, 10)]
    assert dropped_lines(spark, texts[:9]) == texts[:9]


def test_long_lines_recur_from_two_texts(spark):
    long, short = "one two three four five six seven eight nine 10", "a b c d e f g h 9"
    texts = [f"{long}\n{short}\nfirst", f"second\n {long.replace(' ', '  ')}\n{short}", long.replace("10", "11"), f"{long}\n{short}\nfirst"]
    assert dropped_lines(spark, texts) == [texts[0], f"second\n{short}", texts[2], f"{short}\nfirst"]
    assert dropped_lines(spark, [long, long]) == [long, long]  # equal texts count once


def test_lines_below_share_recur_only_as_they_are(spark):
    numbers = [f"own{chr(97 + i)}\n{i} {i + 1} {i + 2} {i + 3}\nPrice ${i} ${i + 1} ${i + 2} ${i + 3}" for i in range(12)]
    assert dropped_lines(spark, numbers) == numbers
    same = [f"own{chr(97 + i)}\n7 8 9 10" for i in range(10)]
    assert dropped_lines(spark, same) == [same[0]] + [x.split("\n")[0] for x in same[1:]]
    last = [f"the name is {w}" for w in "ada ben cleo dan eve finn gus hal ida jon kim".split()]
    assert dropped_lines(spark, last) == last
    digits = [f"All rights reserved {2000 + i}" for i in range(10)]
    assert dropped_lines(spark, digits) == [digits[0]] + [""] * 9


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.standard_normal((600, 16)), np.repeat(rng.standard_normal((1, 16)), 60, 0)]).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = neighbours.nearest_neighbours(df, df.where("vec_id % 20 = 0"), 10).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        hit += len(set(best) & set(g.vec_id))
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and np.allclose(g.score, d[g.vec_id]) and g.score.is_monotonic_increasing
        if q >= 600:
            assert g.vec_id.tolist() == best.tolist()  # ties go to the smaller id
    assert hit >= 0.9 * len(got)


def brute_neighbours(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    place = np.flatnonzero(ids != ids[q])
    return [(int(ids[i]), float(d[i])) for i in place[np.lexsort((ids[place], d[place]))][:k]]


@pytest.mark.parametrize("kind", ["gaussian", "clusters", "copies", "equal"])
def test_neighbours_over_many_shards(spark, monkeypatch, kind):
    """Cells of a few rows, cells cut into several shards, one vector that a third of all rows share."""
    monkeypatch.setattr(neighbours, "PER_CELL", 8)
    rng = np.random.default_rng(7)
    n = 900
    x = {
        "gaussian": lambda: rng.standard_normal((n, 16)),
        "clusters": lambda: 3 * rng.standard_normal((30, 16))[rng.integers(0, 30, n)] + 0.3 * rng.standard_normal((n, 16)),
        "copies": lambda: np.vstack([rng.standard_normal((n - 300, 16)), np.ones((300, 16))]),
        "equal": lambda: np.ones((n, 16)),
    }[kind]().astype(np.float32)
    ids = rng.permutation(n)
    df = spark.createDataFrame([(int(i), v.tolist(), 1, 2) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<float>, shard int, cell int").repartition(5)
    got = collections.defaultdict(list)
    for r in neighbours.nearest_neighbours(df, df.where("vec_id % 10 = 0"), 10, shard_rows=40).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q, own in got.items():
        want = brute_neighbours(ids, x.astype(float), int(np.flatnonzero(ids == q)[0]))
        hit += len({i for i, _ in own} & {i for i, _ in want})
        assert len(own) == 10 and [round(d, 9) for _, d in own] == sorted(round(d, 9) for _, d in own)
        if kind == "equal" or (kind == "copies" and want[-1][1] == 0):
            assert own == want
    assert len(got) == 90 and hit >= 0.95 * 900


def test_neighbours_of_repeated_ids(spark):
    """Repeated rows are candidates of their own, but never of their own id; a repeated query is asked once."""
    some = [(1, [1.0, 1.0])] * 30 + [(2, [1.0, 1.0])] * 3 + [(3, [1.0, 2.0]), (100, [1.0, 1.0]), (100, [1.0, 1.0])]
    df = spark.createDataFrame(some, "vec_id bigint, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest_neighbours(df, df.where("vec_id in (1, 100)"), 5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2), (1, 2, 2), (1, 3, 2), (1, 4, 100), (1, 5, 100)] + [(100, i, 1) for i in range(1, 6)]


def test_chi_square():
    rng = np.random.default_rng(1)
    draws = (rng.standard_normal((20_000, 8)) ** 2).sum(1)
    assert all(abs(neighbours.chi_square(v, 8) - (draws <= v).mean()) < 0.02 for v in (2.0, 7.0, 15.0))


def plain_spans(rows, length):
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mask[i : i + length] = True
        out.append((d, len(b), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mask])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [4000, 2])
def test_suffix_dedup(spark, docs, rows, monkeypatch, limit):
    """``limit`` 2 splits every anchor with more runs into shards, which are merged by binary search."""
    monkeypatch.setattr(suffix_dedup, "SHARD_RUNS", limit)
    rng = random.Random(2)
    shared = " ".join(words_of(rng, 40))
    more = [(1000 + i, " ".join(words_of(rng, 10 + i)) + shared + " ".join(words_of(rng, 12))) for i in range(9)] + [(2000, "ab" * 90), (2001, "q" * 120 + "é" * 70), (2002, "zq" * 30 + "ab" * 40)]
    some = [r[:2] for r in rows if len(r[1] or "") < 1500] + more
    df = spark.createDataFrame(some, "doc_id bigint, text string").repartition(4)
    got = suffix_dedup.repeated_spans(df, length=60, anchor=20).collect()
    found = [(r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert sorted(found, key=str) == plain_spans(some, 60)


def test_suffix_dedup_of_all_rows(spark, docs, rows):
    """Null and repeated ids and the longest texts too."""
    got = suffix_dedup.repeated_spans(docs, length=200, anchor=64).collect()
    found = [(r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert sorted(found, key=str) == plain_spans([r[:2] for r in rows], 200)


def test_language_of_a_very_long_text(spark):
    """Half a million words are read whole: the language of most of them, which come last, is told."""
    rows = [("aa", 0, "hello", 0.5), ("bb", 0, "salut", 0.5)]
    table = pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("lang", pa.string()), ("size", pa.int32()), ("gram", pa.string()), ("share", pa.float64())))})
    model = language.Languages(table, 1e-6)
    assert language.classify(["hello " * 200_000 + "salut " * 300_000, "hello " * 300_000 + "salut " * 200_000], model, language.rows_of(model))[0] == ["bb", "aa"]


def test_suffix_array_and_common_prefixes():
    rng = random.Random(1)
    for _ in range(60):
        t = bytes(rng.choices(b"ab\0c", k=rng.randint(1, 150))) * rng.randint(1, 3)
        raw = np.frombuffer(t, np.uint8)
        order = suffix_dedup.suffix_array(raw)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        lcp = suffix_dedup.common_prefixes(raw, order, 40, 8)
        for q in range(1, len(t)):
            a, b = t[order[q - 1] :], t[order[q] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lcp[q] == min(n, 40)


def test_pu_quality_query_against_brute_force(spark, tmp_path):
    """The whole query: features, roles, prior from held-back positives and all unlabelled rows, network, scores; one id has most of the rows."""
    rng = random.Random(21)
    docs = [(i, " ".join(words_of(rng, rng.randint(0, 60))).capitalize() + "." if i % 3 else "#$% <|> " * rng.randint(0, 20)) for i in range(150)]
    docs += [(7, "the same id and text") for _ in range(700)] + [(None, "no id"), (151, None), (152, "")]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 150, 2)] + [(4, 0), (None, 1), (9999, 1)]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 3 == 1
    x = [(i, pu_quality.features((t or "").encode())) for i, t in docs]
    learned = [(i, v) for i, v in x if not held(i)]
    every = np.array([v for _, v in learned])
    mean, scale = np.round(every.mean(0), 6), np.round(every.std(0), 6) + 1e-3
    by_id = {}
    for i, v in learned:
        by_id[i] = min(tuple(v), by_id.get(i, tuple(v)))
    good_ids = {i for i, q in labels if q == 1 and not held(i)}
    good = np.array([v for i, v in sorted(by_id.items()) if i in good_ids])
    any_ = np.array([v for _, v in sorted(by_id.items())])
    half = np.arange(len(good)) % 2 == 0
    first = pu_quality.Network(mean, scale, None).fit(good[half], any_, steps=pu_quality.STEPS // 3)
    told = first.score(good[~half])
    cuts = np.append(np.quantile(told, np.linspace(0, 1 - pu_quality.MOST, pu_quality.CUTS)), 0.0)
    shares = [(float((told >= c).mean()), float((first.score(every) >= c).mean())) for c in cuts]
    prior = min(1.0, max(0.01, min([0.99, *[b / a for a, b in shares if a >= pu_quality.MOST]])))
    net = pu_quality.Network(mean, scale, prior).fit(good, any_)
    key = lambda i, s: (i is None, i or 0, s)
    got = sorted(((r.doc_id, r.held_out, r.score, r.predicted) for r in queries.op3_pu_quality(spark, str(tmp_path)).collect()), key=lambda r: key(r[0], r[2]))
    want = sorted(((i, held(i), float(net.score(v[None])[0])) for i, v in x), key=lambda r: key(r[0], r[2]))
    assert [(r[0], r[1]) for r in got] == [w[:2] for w in want] and [r[2] for r in got] == pytest.approx([w[2] for w in want], abs=1e-6)
    assert all(r[3] == int(r[2] >= 0.5) for r in got)


@pytest.mark.parametrize("repeats", [1, 3000])
def test_draws_are_of_ids_not_rows(spark, repeats):
    """One id with very many rows leaves a draw whole, and what is learned from bounded."""
    ids = spark.range(60).select(F.col("id").alias("doc_id"))
    ids = ids.unionByName(spark.range(repeats).select(F.lit(5).cast("long").alias("doc_id")))
    docs = ids.select("doc_id", F.concat(F.lit("word "), F.monotonically_increasing_id().cast("string")).alias("text"))
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"), F.lit(1).alias("quality"))
    index = toxicity.train(docs, docs.select("text"), labels, sample=59)
    assert len(index.state[2]) == 59 and len(set(index.state[2].tolist())) == 59
    rows = pu_quality.featured(docs)
    seen = []
    real = pu_quality.Network.fit
    pu_quality.Network.fit = lambda self, good, any_, **k: seen.append((len(good), len(any_))) or real(self, good, any_, steps=2)
    try:
        pu_quality.train(rows, labels, sample=40)
    finally:
        pu_quality.Network.fit = real
    assert seen == [(20, 40), (40, 40)]
