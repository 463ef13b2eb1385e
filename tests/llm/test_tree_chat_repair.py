"""Manifest, chat templates and repair against plain versions."""

import hashlib
import random
import re
import zlib

import pytest

from plumbline.llm import chat_template, conversation_repair, merkle, queries
from plumbline.llm.chat_template import Template, TemplateError, escaper, unescape

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, at string, key string, size string"
CONVS = "conv_id bigint, turn bigint, role string, text string, key string, kind string, path string"


# manifest


def manifest_rows():
    rng = random.Random(3)
    rows = [(i, "big" if i % 3 else rng.choice(["a", "é", "B", ""]), rng.choice(["x", None]), rng.choice([i, None]), rng.choice(["Some TEXT é漢", "", None, "low", "Ab" * 3000])) for i in range(300)]
    rows += [(7, None, None, None, None), (None, "big", "x", 1, "No Id"), (None, "big", "x", 1, "No Id"), rows[4], rows[4], (4, "big", "x", 4, "same id, OTHER text"), (900, "lone", "x", 1, "One")]
    return [(*r, "l", "a", "k", "s") for r in rows]


def plain_manifest(rows, fanout):
    leaf = lambda r: SHA("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(hashes):
        """The root and each leaf's (left, right) siblings, level by level."""
        paths, groups = [[] for _ in hashes], [[i] for i in range(len(hashes))]
        while len(hashes) > 1:
            up, merged = [], []
            for i in range(0, len(hashes), fanout):
                run = hashes[i : i + fanout]
                for j, members in enumerate(groups[i : i + fanout]):
                    for m in members:
                        paths[m].append(("".join(run[:j]), "".join(run[j + 1 :])))
                up.append(SHA("".join(run)))
                merged.append([m for g in groups[i : i + fanout] for m in g])
            hashes, groups = up, merged
        return hashes[0], paths

    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r[:5])
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (own, *tree([leaf(r) for r in own]))
    root, over = tree([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, over, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            path = path + top
            h, text = leaf(r), r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if c.isascii() else c for c in text)
            v = leaf((*r[:4], text))
            for a, b in path:
                v = SHA(a + v + b)
            out.append((r[0], h, subroot, root, SHA("".join(a + b for a, b in path)), v, v == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout", [16, 3])
def test_manifest(spark, tmp_path, fanout, monkeypatch):
    rows = manifest_rows()
    monkeypatch.setattr(queries, "merkle_manifest", lambda docs, claims: merkle.merkle_manifest(docs, claims, fanout=fanout))
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_manifest(rows, fanout)
    assert {r.verified for r in found} == {True, False}


def test_manifest_of_few(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op11_merkle_manifest(spark, f"{tmp_path}/none").collect() == []
    one = [(1, "s", None, 2, "xY", "", "", "", "")]
    spark.createDataFrame(one, DOCS).write.parquet(f"{tmp_path}/one/documents.parquet")
    assert [tuple(r) for r in queries.op11_merkle_manifest(spark, f"{tmp_path}/one").collect()] == plain_manifest(one, 16)


def test_manifest_of_a_row_repeated_without_end(spark):
    rows = spark.range(3000).selectExpr("1L AS doc_id", "'s' AS source", "'x' AS lang", "1L AS n_chars", "'t' AS text")
    found = merkle.merkle_manifest(rows).select("leaf", "root", "folded").distinct().collect()
    assert len(found) == 1 and found[0].root == found[0].folded


# chat


def rendered(source, messages, **more):
    return "".join(p for p in Template(source, **more)(messages) if isinstance(p, str))


def test_template_language():
    some = [{"role": "user", "text": "a"}, {"role": "assistant", "text": "b"}]
    assert rendered("{% for m in messages %}{{ loop.index }}{{ m.role|upper }}{% if not loop.last %}, {% endif %}{% endfor %}", some) == "1USER, 2ASSISTANT"
    assert rendered("{% set x = 'p' ~ 1 %}{% for m in messages %}{% if m['text'] == 'a' or loop.first and false %}{{ x }}{% elif 'b' in m.text %}B{% else %}C{% endif %}{% endfor %}", some) == "p1B"
    assert rendered("x {{- ' y ' -}} z", []) == "x y z"
    assert rendered("{{ none }}{{ ('a' + 'b')|upper }}{{ 'it\\'s\\n' }}", []) == "ABit's\n"
    assert rendered("{{ bos }}|{{ sep }}", [], constants={"bos": "<b>", "sep": "--"}) == "<b>|--"
    assert rendered("", some) == ""


def test_constants_fold():
    assert Template("a{{ 'b' + 'c' }}{% if 1 == 2 %}no{% else %}d{% endif %}").tree in ([("text", "abcd")], [("text", "abc"), ("text", "d")])
    assert Template("{{ bos|upper }}").tree == [("text", "<S>")]
    assert Template("{% if true and 'x' in 'xyz' %}{{ eos }}{% endif %}").tree == [("text", "</s>")]


@pytest.mark.parametrize("source", [
    "{{ secret }}", "{{ messages }}", "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{% for m in others %}{% endfor %}", "{% if true %}", "{% endfor %}", "{{ 'a' 'b' }}", "{{ 'a'.__class__() }}",
    "{{ 'a'|system }}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{% set loop = 1 %}", "{% set bos = 1 %}", "{{ 1 + }}", "{% include 'x' %}", "{% if true %}" * 60 + "{% endif %}" * 60, "x" * 70_000,
])
def test_template_is_closed(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_members_are_keys_only():
    assert rendered("{% for m in messages %}{{ m.keys }}{{ m.__class__ }}{{ m.role.upper }}{% endfor %}", [{"role": "user", "text": ""}]) == ""


def test_escape_goes_back():
    escape, rng = escaper(chat_template.CONTROLS), random.Random(1)
    pieces = [*chat_template.CONTROLS, "\\", "<", "[", ">", "s", "|", "é🙂", "\n", "</", "[[INST]", "<<"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 9)))
        safe = escape(text)
        assert unescape(safe) == text and not any(c in safe for c in chat_template.CONTROLS)


def chat_rows():
    rng = random.Random(2)
    texts = ["", None, "<s>", "a\\", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user<|im_sep|>", "é🙂", "x" * 20_000, "plain"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<|im_sep|>", ""]), rng.choice(texts)) for c in range(40) for t in range(rng.randint(1, 7))]
    rows += [(None, 1, "user", "no id"), (None, None, "assistant", "nor turn"), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"), (50, None, "user", "null turn"), (50, 0, "assistant", "after")]
    return [(*r, "k", "k", "k") for r in rows]


def plain_chat(rows):
    out = {}
    rows = [r[:4] for r in rows] + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    escape = escaper(chat_template.CONTROLS)
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        whole = "<s>" + "".join(f"<|im_start|>{escape(r)}<|im_sep|>{escape(x)}<|im_end|>\n" for _, _, r, x in own) + "</s>"
        out[c] = (len(own), SHA("".join(f"{r}\n{x}\n" for _, _, r, x in own)), len(loss), SHA(loss), len(whole))
    return out


def test_chat_query(spark, tmp_path):
    rows = chat_rows()
    spark.createDataFrame(rows, CONVS).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op12_chat_format(spark, str(tmp_path)).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == plain_chat(rows) and len(found) == len(plain_chat(rows))


def test_chat_parts(spark):
    """Conversations beyond the size of a part come in several, and read the same."""
    rows = spark.createDataFrame([r[:4] for r in chat_rows()], "conv_id bigint, turn bigint, role string, text string")
    small = chat_template.format_conversations(rows, limit=64).cache()
    assert small.groupBy("conv_id").count().agg({"count": "max"}).first()[0] > 3
    back = chat_template.read_back(chat_template.format_conversations(rows, limit=64))
    assert {r[0]: tuple(r)[1:] for r in back.collect()} == {k: v for k, v in plain_chat(chat_rows()).items() if k != -1}


def test_chat_of_none(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat_template.read_back(chat_template.format_conversations(none)).collect() == []


def test_read_back_refuses_other_formats(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    with pytest.raises(Exception, match="as the template has it"):
        chat_template.read_back(chat_template.format_conversations(rows, template="{% for m in messages %}{{ m.text }}{% endfor %}")).collect()


# repair


def cheapest(kinds, roles, texts):
    """(cost, audit, lines) by trying every script of edits with at most two insertions in a row."""
    best = None
    fine = re.compile(r"(s?(ua)+)?")
    prefix = re.compile(r"(s?(ua)*u?)?")

    def walk(i, run, cost, audit, names, lines):
        nonlocal best
        if not prefix.fullmatch(names) or (best and cost > best[0]):
            return
        if i == len(kinds) and fine.fullmatch(names):
            here = (cost, audit, lines)
            best = here if best is None or here[:2] < best[:2] else best
        if run < 2:
            for n, role in (("u", "user"), ("a", "assistant")):
                walk(i, run + 1, cost + 5, audit + "I", names + n, [*lines, f"{role}:"])
        if i == len(kinds):
            return
        walk(i + 1, 0, cost + 2, audit + "D", names, lines)
        if kinds[i] in "bd":
            return
        more = 5 if kinds[i] == "t" else 0
        if roles[i]:
            walk(i + 1, 0, cost + more, audit + "K", names + roles[i][0], [*lines, f"{roles[i]}:{texts[i]}"])
        for n, role in (("u", "user"), ("a", "assistant")):
            walk(i + 1, 0, cost + 1 + more, audit + "R", names + n, [*lines, f"{role}:{texts[i]}"])

    walk(0, 0, 0, "", "", [])
    return best


def plain_repair(rows):
    hurt = {}
    for c, t, r, x in rows:
        own = hurt.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if f == 0:
            continue
        x = "" if f == 1 else re.sub("[.!?]", "", x) if f == 2 else x
        own += [(t, "user" if f == 4 else r, x)] * (2 if f == 3 else 1)
    out = []
    for c, own in hurt.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        kinds, seen = [], set()
        for _, r, x in own:
            bare = x.strip(" \t\n\x0b\x0c\r")
            kinds.append("b" if not bare else "d" if (r, x) in seen else "t" if bare[-1] not in ".!?" else "k")
            seen.add((r, x))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, lines = cheapest(kinds, [r for _, r, _ in own], [x for _, _, x in own])
        out.append((c, gaps, *[kinds.count(k) for k in "bdt"], illegal, cost, audit, SHA("\n".join(lines))))
    return sorted(out, key=str)


def repair_rows():
    rng = random.Random(5)
    texts = ["Fine.", "Why?", "open", "", None, " \t", "Yes!\n ", "é漢.", "Fine.", "a.b", "No.  "]
    rows = [(c, t * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "ua"]), rng.choice(texts)) for c in range(150) for t in range(rng.randint(1, 7))]
    rows += [(None, 1, "user", "Hm."), (None, None, "assistant", "So."), (200, None, "user", "Q."), (200, None, "user", "Q."), (200, 4, "assistant", "A.")]
    return rows


@pytest.mark.parametrize("piece", [64, 2])
def test_repair_query(spark, tmp_path, piece, monkeypatch):
    """In pieces of two rows, conversations go through several rounds."""
    monkeypatch.setattr(conversation_repair, "PIECE", piece)
    rows = repair_rows()
    spark.createDataFrame([(*r, "", "", "") for r in rows], CONVS).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_repair(rows)


def test_repair_of_none(spark, tmp_path):
    spark.createDataFrame([], CONVS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op13_conversation_repair(spark, str(tmp_path)).collect() == []


def test_repair_of_all_dropped(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "x", "", "", "")], CONVS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", SHA(""))]


def test_repair_of_a_long_conversation(spark):
    """A conversation of 5,000 rows in 79 pieces keeps what is sound, and its repeated row."""
    rows = spark.range(5000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "if(id = 100, 'Text 98.', concat('Text ', id, '.')) AS text")
    found = conversation_repair.repair_conversations(rows, rows).collect()
    # row 100 repeats row 98 and goes; the answer beside it goes too, which of the two by the audit
    assert [tuple(r)[:8] for r in found] == [(1, 0, 0, 1, 0, 0, 4, "K" * 99 + "DD" + "K" * 4899)]
