"""Chat formatting by compiled templates.

A template is text with ``{{ value }}``, ``{% for x in messages %}``, ``{% if %}``, ``{% elif %}``, ``{% else %}``,
``{% set x = value %}`` and ``{% generation %}``, each closed by its ``end`` tag; a dash inside a tag's bracket strips the
white space on that side. Values are texts, whole numbers, ``true``, ``false``, ``none``, names, members (``m.role``,
``m['role']``), ``+`` and ``~`` (joined as text), ``==``, ``!=``, ``in``, ``not``, ``and``, ``or`` and filters. It is parsed to a
syntax tree, constants are folded (values, branches, neighbouring texts), and each node becomes a Python closure, a
generator of pieces. The language is closed: names are checked when it is compiled, members are keys of messages and of
``loop``, filters come from a fixed list, and ``messages`` may be looped over once, so that a rendering takes time in
proportion to the conversation and holds one message at a time.

Conversations are dealt and sorted by id and stream through the closures. What is formatted comes in parts of about
``PART`` characters with the spans that the model is to learn; no span is cut. Control strings inside texts are escaped by a
backslash behind their first sign, backslashes by a second one, so texts come back exactly.

Defined results: rows go by turn, null first, then by role and text; a null role or text is empty; rows with a null
conversation are one conversation; repeated rows are turns of their own; empty texts are turns without text; a very long
conversation is several parts, a very long text is whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The strings that steer common chat models.
BOS, EOS = "<s>", "</s>"
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_sep|>", "<|im_end|>")
TURNS = """{{ bos }}{% for m in messages -%}
    {{ '<|im_start|>' + m.role|escape + '<|im_sep|>' }}
    {%- if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}<|im_end|>
{% endfor %}{{ eos }}"""

PART = 1 << 20
DEEPEST, LONGEST = 40, 1 << 16
BEGIN_SPAN, END_SPAN = object(), object()


class TemplateError(ValueError):
    pass


def escaper(controls: tuple[str, ...]) -> Callable[[str], str]:
    if any("\\" in c or not c for c in controls):
        raise TemplateError("control strings are not empty and have no backslash")
    hit = re.compile(r"\\|(?=" + "|".join(map(re.escape, controls)) + r")[\s\S]") if controls else re.compile(r"\\")
    return lambda text: hit.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


LEXEME = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[+~.|()\[\]=]))""")
TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}", re.S)
WORDS = {"true": True, "false": False, "none": None}
OPERATIONS: dict[str, Callable] = {
    "+": lambda a, b: _text(a) + _text(b), "~": lambda a, b: _text(a) + _text(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "in": lambda a, b: _text(a) in _text(b), "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}
LEVELS = (("or",), ("and",), ("==", "!=", "in"), ("+", "~"))


def _text(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else str(value)


class Template:
    """A compiled template; calling it with an iterable of messages gives pieces of text and, around what is generated, BEGIN_SPAN and END_SPAN."""

    def __init__(self, source: str, constants: dict[str, str] | None = None, controls: tuple[str, ...] = CONTROLS):
        if len(source) > LONGEST:
            raise TemplateError("the template is too long")
        self.constants = {"bos": BOS, "eos": EOS} if constants is None else constants
        self.filters = {"escape": escaper(controls), "trim": str.strip, "lower": str.lower, "upper": str.upper}
        self.tags, self.at, self.depth, self.looped, self.generating = list(self._cut(source)), 0, 0, False, False
        tree, stop = self._block(set(), ())
        if stop is not None:
            raise TemplateError(f"unexpected {stop}")
        self.tree = tree
        self.run = self._closure(tree)

    def __call__(self, messages: Iterable[dict]) -> Iterator[object]:
        return self.run({"messages": messages})

    # text to tags

    def _cut(self, source: str) -> Iterator[tuple[str, str]]:
        at, strip = 0, False
        for m in TAG.finditer(source):
            text = source[at : m.start()]
            text = text.lstrip() if strip else text
            yield "text", text.rstrip() if m[1] or m[4] else text
            yield ("value", m[2]) if m[2] is not None else ("tag", m[5].strip())
            at, strip = m.end(), bool(m[3] or m[6])
        yield "text", source[at:].lstrip() if strip else source[at:]

    # tags to a tree of statements: (text, s), (value, e), (if, e, then, else), (for, name, body), (set, name, e), (generation, body)

    def _block(self, names: set[str], ends: tuple[str, ...]) -> tuple[list, str | None]:
        """Statements up to one of ``ends``, and that tag."""
        self.depth += 1
        if self.depth > DEEPEST:
            raise TemplateError("the template is nested too deeply")
        out: list = []
        while self.at < len(self.tags):
            kind, body = self.tags[self.at]
            self.at += 1
            word = body.split(None, 1)[0] if kind == "tag" and body else ""
            if kind == "text":
                self._add(out, body)
            elif kind == "value":
                e = self._value(body, names)
                self._add(out, _text(e[1])) if e[0] == "const" else out.append(("value", e))
            elif word in ends:
                self.depth -= 1
                return out, body
            elif word == "if":
                out += self._branch(body[2:], names)
            elif word == "for":
                m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+messages", body)
                if not m or self.looped:
                    raise TemplateError("a template loops over messages, once")
                self.looped = True
                out.append(("for", m[1], self._block(names | {m[1], "loop"}, ("endfor",))[0]))
            elif word == "set":
                m = re.fullmatch(r"set\s+([A-Za-z_]\w*)\s*=(.*)", body, re.S)
                if not m or m[1] in ("messages", "loop") or m[1] in self.constants:
                    raise TemplateError(f"can't set: {body}")
                out.append(("set", m[1], self._value(m[2], names)))
                names.add(m[1])
            elif word == "generation":
                if self.generating:
                    raise TemplateError("generation inside generation")
                self.generating = True
                out.append(("generation", self._block(names, ("endgeneration",))[0]))
                self.generating = False
            else:
                raise TemplateError(f"unexpected {body!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        self.depth -= 1
        return out, None

    @staticmethod
    def _add(out: list, text: str) -> None:
        if out and out[-1][0] == "text":
            text = out.pop()[1] + text
        if text:
            out.append(("text", text))

    def _branch(self, test: str, names: set[str]) -> list:
        """An if as a list of statements: one, or those of the branch that a constant test takes. What a branch sets holds inside it."""
        e = self._value(test, names)
        then, stop = self._block(set(names), ("elif", "else", "endif"))
        other: list = []
        if stop.startswith("elif"):
            other = self._branch(stop[4:], names)
        elif stop == "else":
            other = self._block(set(names), ("endif",))[0]
        if e[0] == "const":
            return then if e[1] else other
        return [("if", e, then, other)]

    # values: (const, v), (name, n), (member, e, key), (not, e), (sign, a, b), (filter, name, e)

    def _value(self, body: str, names: set[str]) -> tuple:
        found, at, body = [], 0, body.strip()
        while at < len(body):
            m = LEXEME.match(body, at)
            if not m:
                raise TemplateError(f"can't read {body[at:]!r}")
            found.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        e, rest = self._level(found, 0, names, 0)
        if rest < len(found):
            raise TemplateError(f"unexpected {found[rest][1]!r} in {body!r}")
        return e

    def _level(self, found: list, at: int, names: set[str], level: int) -> tuple[tuple, int]:
        if level == len(LEVELS):
            return self._single(found, at, names)
        if level == 2 and found[at : at + 1] == [("name", "not")]:
            e, at = self._level(found, at + 1, names, level)
            return (("const", not e[1]) if e[0] == "const" else ("not", e)), at
        e, at = self._level(found, at, names, level + 1)
        while at < len(found) and found[at][1] in LEVELS[level] and found[at][0] != "text":
            sign = found[at][1]
            b, at = self._level(found, at + 1, names, level + 1)
            e = ("const", OPERATIONS[sign](e[1], b[1])) if e[0] == b[0] == "const" else (sign, e, b)
        return e, at

    def _single(self, found: list, at: int, names: set[str]) -> tuple[tuple, int]:
        if at >= len(found):
            raise TemplateError("a value is missing")
        (kind, word), at = found[at], at + 1
        sign = lambda i: found[i][1] if i < len(found) and found[i][0] != "text" else None
        if kind == "text":
            e = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1], flags=re.S))
        elif kind == "number":
            e = ("const", int(word))
        elif word == "(":
            e, at = self._level(found, at, names, 0)
            if sign(at) != ")":
                raise TemplateError("missing )")
            at += 1
        elif word in WORDS:
            e = ("const", WORDS[word])
        elif word in self.constants:
            e = ("const", self.constants[word])
        elif word in names:
            e = ("name", word)
        else:
            raise TemplateError(f"unknown name {word!r}")
        while sign(at) in (".", "[", "|"):
            name = found[at + 1] if at + 1 < len(found) else (None, None)
            if sign(at) == "|":
                if name[1] not in self.filters:
                    raise TemplateError(f"unknown filter {name[1]!r}")
                f = self.filters[name[1]]
                e, at = ("const", f(_text(e[1]))) if e[0] == "const" else ("filter", name[1], e), at + 2
            elif sign(at) == "." and name[0] == "name":
                e, at = ("member", e, name[1]), at + 2
            elif sign(at) == "[" and name[0] == "text" and sign(at + 2) == "]":
                e, at = ("member", e, name[1][1:-1]), at + 3
            else:
                raise TemplateError("a member is a name or a text")
        return e, at

    # the tree to closures

    def _closure(self, block: list) -> Callable[[dict], Iterator[object]]:
        steps = [getattr(self, f"_do_{kind}")(*rest) for kind, *rest in block]

        def run(scope: dict) -> Iterator[object]:
            for step in steps:
                yield from step(scope)

        return run

    def _do_text(self, text: str) -> Callable:
        piece = (text,)
        return lambda scope: piece

    def _do_value(self, e: tuple) -> Callable:
        value = self._worth(e)
        return lambda scope: (_text(value(scope)),)

    def _do_set(self, name: str, e: tuple) -> Callable:
        value = self._worth(e)

        def run(scope: dict) -> tuple:
            scope[name] = value(scope)
            return ()

        return run

    def _do_if(self, e: tuple, then: list, other: list) -> Callable:
        test, yes, no = self._worth(e), self._closure(then), self._closure(other)
        return lambda scope: yes(scope) if test(scope) else no(scope)

    def _do_for(self, name: str, body: list) -> Callable:
        each = self._closure(body)

        def run(scope: dict) -> Iterator[object]:
            i, items = 0, iter(scope["messages"])
            item = next(items, None)
            while item is not None:
                after = next(items, None)
                yield from each({**scope, name: item, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": after is None}})
                i, item = i + 1, after

        return run

    def _do_generation(self, body: list) -> Callable:
        inner = self._closure(body)

        def run(scope: dict) -> Iterator[object]:
            yield BEGIN_SPAN
            yield from inner(scope)
            yield END_SPAN

        return run

    def _worth(self, e: tuple) -> Callable[[dict], object]:
        kind = e[0]
        if kind == "const":
            return lambda scope: e[1]
        if kind == "name":
            return lambda scope: scope[e[1]]
        if kind == "filter":
            f, value = self.filters[e[1]], self._worth(e[2])
            return lambda scope: f(_text(value(scope)))
        a = self._worth(e[1])
        if kind == "not":
            return lambda scope: not a(scope)
        if kind == "member":

            def member(scope: dict) -> object:
                held = a(scope)
                return held.get(e[2]) if isinstance(held, dict) else None

            return member
        b = self._worth(e[2])
        if kind == "and":
            return lambda scope: a(scope) and b(scope)
        if kind == "or":
            return lambda scope: a(scope) or b(scope)
        f = OPERATIONS[kind]
        return lambda scope: f(a(scope), b(scope))


def parts(pieces: Iterable[object], limit: int = PART) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Texts of about ``limit`` characters with the spans in them; one at least."""
    text, n, spans, begun, some = [], 0, [], None, False
    for p in pieces:
        if p is BEGIN_SPAN:
            begun = n
        elif p is END_SPAN:
            spans.append((begun, n))
            begun = None
        else:
            text.append(p)
            n += len(p)
        if n >= limit and begun is None:
            yield "".join(text), spans
            text, n, spans, some = [], 0, [], True
    if n or not some:
        yield "".join(text), spans


SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def format_conversations(rows: DataFrame, template: str = TURNS, constants: dict[str, str] | None = None, controls: tuple[str, ...] = CONTROLS, limit: int = PART, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, part, text, spans): each conversation as the template renders it, its parts together and in order; spans are half-open places of what is generated."""
    Template(template, constants, controls)  # errors belong to the driver
    own = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = own.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = Template(template, constants, controls)
        ids: list = []

        def stream() -> Iterator[tuple]:
            for b in batches:
                ids[:] = [b.schema.field("conv_id").type]
                yield from zip(*[b.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True)

        out, size = [], 0

        def batch() -> pa.RecordBatch:
            types = (ids[0], pa.int32(), pa.string(), SPANS)
            made = pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=["conv_id", "part", "text", "spans"])
            out.clear()
            return made

        for key, group in groupby(stream(), key=lambda r: r[0]):
            for i, (whole, spans) in enumerate(parts(render({"role": r[1], "text": r[2]} for r in group), limit)):
                out.append((key, i, whole, [{"begin": a, "end": b} for a, b in spans]))
                size += len(whole)
                if size >= 4 * limit:
                    yield batch()
                    size = 0
        if out:
            yield batch()

    dealt = own.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind.simpleString()}, part int, text string, spans array<struct<begin: int, end: int>>")


class Reader:
    """Turns and learned text of a conversation that TURNS has formatted, read from its parts."""

    def __init__(self) -> None:
        self.rest, self.n, self.chars, self.loss_chars = None, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, text: str, spans: list[dict]) -> None:
        self.chars += len(text)
        for s in spans:
            learned = unescape(text[s["begin"] : s["end"]])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())
        text = text if self.rest is None else self.rest + text
        at = 0
        if self.rest is None:
            if not text.startswith(BOS):
                raise ValueError("a conversation does not begin as the template has it")
            at = len(BOS)
        while text.startswith(START, at) and (end := text.find(END, at)) >= 0:
            sep = text.index(SEP, at, end)
            self.turns.update(f"{unescape(text[at + len(START) : sep])}\n{unescape(text[sep + len(SEP) : end])}\n".encode())
            self.n, at = self.n + 1, end + len(END)
        self.rest = text[at:]

    def row(self) -> tuple:
        if self.rest != EOS:
            raise ValueError("a conversation does not end as the template has it")
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what ``format_conversations`` gives by TURNS, on whose order it relies."""
    kind = formatted.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, key, types, out = None, None, None, []

        def batch() -> pa.RecordBatch:
            made = pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.clear()
            return made

        for b in batches:
            types = (b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            for conv, part, text, spans in zip(*[b.column(c).to_pylist() for c in ("conv_id", "part", "text", "spans")], strict=True):
                if part == 0:
                    if reader is not None:
                        out.append((key, *reader.row()))
                    reader, key = Reader(), conv
                reader.take(text, spans)
            yield batch()
        if reader is not None:
            out.append((key, *reader.row()))
            yield batch()

    return formatted.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
