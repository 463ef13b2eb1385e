"""Repair of conversations: the cheapest edits that make the roles alternate.

Roles must read ``(s?(ua)+)?`` by their initials. A row is kept (cost 0), given another role (1), deleted (2), or a row
without text is inserted (5); a blank row or one that repeats an earlier one must be deleted, and a truncated row that
stays costs 5 more. Of the cheapest edits those count whose initials come first.

A row is a kind, one letter for its role's initial and fault, and what an edit does depends on the kind and on how far
the grammar has come: 0 nothing yet, 1 after the system row, 2 after a user, 3 after an assistant. Conversations are cut
into pieces of ``PIECE`` rows. In batches that a hash of conversation and piece deals out, a recursive DuckDB query goes
forward one row at a time in all pieces at once and keeps, for each state to begin and to end with, the least cost and
its first audit. Pieces of longer conversations are then joined by the same query, ``PIECE`` at a time, so that none has
to pass one task as rows. Edits never end in an insertion before the last row is met, so of two audits that tie the
first stays first whatever follows.

The repaired rows come from a single pass over rows dealt and sorted by conversation; a conversation of any length
streams through it, with only its audit, a letter a row, in memory. Its digest is one sequence of bytes by its contract,
so it is taken where the rows stream past.

Defined results: rows go by turn, null first, then by the md5 of role and text; a null role or text is one blank; an
empty role and one that begins with another letter than s, u or a is never kept; a null conversation is one of its own;
repeated rows are duplicates, the first of them is not; texts of any length are whole; a conversation without rows has
zeros, an empty audit and nothing repaired; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import BLANKS, WORD, materialise
from plumbline.operators.ranks import placed

PIECE = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What a role's initial does to the state; insertions and new roles are of users and assistants, in the audit's letters.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
INSERTS, REROLES = {"u": "I", "a": "i"}, {"u": "R", "a": "r"}


def moves() -> list[tuple[str, int, int, int, str]]:
    """(kind, state, next, cost, letters) of insertions and one edit. Kinds: d must go, a small initial is sound, a capital one truncated."""
    before = [(p, p, 0, "") for p in range(4)]
    for _ in range(2):  # a user, or a user and an assistant
        before += [(p, step[q], c + INSERT, e + INSERTS[r]) for p, q, c, e in before for r, step in STEPS.items() if r in INSERTS and q in step and step[q] != p]
    out = set()
    for kind in "dsuaxSUAX":
        more = TRUNCATED if kind.isupper() else 0
        for p, q, c, e in before:
            out.add((kind, p, q, c + DELETE, e + "D"))
            if kind == "d":
                continue
            if q in STEPS.get(kind.lower(), {}):
                out.add((kind, p, STEPS[kind.lower()][q], c + KEEP + more, e + "K"))
            out |= {(kind, p, STEPS[r][q], c + REROLE + more, e + letter) for r, letter in REROLES.items() if q in STEPS[r]}
    return sorted(out)


BEST = "min(struct_pack(cost := t.cost + m.cost, audit := upper(t.path || m.letters), path := t.path || m.letters))"
#: Rows of all pieces, one further in each recursion. ``items`` has (g, n, kinds, starts).
ALONG = f"""WITH RECURSIVE t(g, start, state, k, n, kinds, cost, path) USING KEY (g, start, state) AS (
    SELECT g, s, s, 0, n, kinds, 0::BIGINT, '' FROM (SELECT g, n, kinds, unnest(starts) AS s FROM items) UNION
    SELECT g, start, next, k + 1, n, kinds, b.cost, b.path FROM (SELECT t.g, t.start, m.next, any_value(t.k) AS k, any_value(t.n) AS n, any_value(t.kinds) AS kinds, {BEST} AS b
        FROM t JOIN moves m ON m.kind = substr(t.kinds, t.k + 1, 1) AND m.state = t.state WHERE t.k < t.n GROUP BY t.g, t.start, m.next))
    SELECT g, start, state, cost, path FROM t WHERE k = n"""
#: Pieces of all conversations, one further in each recursion. ``items`` has (g, n, starts), ``parts`` what each piece does: (g, k, start, state, cost, letters).
ACROSS = f"""WITH RECURSIVE t(g, start, state, k, n, cost, path) USING KEY (g, start, state) AS (
    SELECT g, s, s, 0, n, 0::BIGINT, '' FROM (SELECT g, n, unnest(starts) AS s FROM items) UNION
    SELECT g, start, next, k + 1, n, b.cost, b.path FROM (SELECT t.g, t.start, m.state AS next, any_value(t.k) AS k, any_value(t.n) AS n, {BEST} AS b
        FROM t JOIN parts m ON m.g = t.g AND m.k = t.k AND m.start = t.state WHERE t.k < t.n GROUP BY t.g, t.start, m.state))
    SELECT g, start, state, cost, path FROM t WHERE k = n"""
ENTRIES = "key string, piece bigint, start int, state int, cost bigint, path string"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of batches (key, piece, kinds) or (key, piece, parts)."""
    import duckdb

    db = duckdb.connect(config={"threads": 1})
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]).append_column("g", pa.array(range(b.num_rows), pa.int64()))
        db.register("rows_", t)
        starts = "CASE WHEN piece = 0 THEN [0] ELSE [0, 1, 2, 3] END AS starts"
        if "kinds" in t.column_names:
            db.register("moves", pa.Table.from_pylist([dict(zip(("kind", "state", "next", "cost", "letters"), m, strict=True)) for m in moves()]))
            db.sql(f"CREATE OR REPLACE TEMP VIEW items AS SELECT g, length(kinds) AS n, kinds, {starts} FROM rows_")
        else:
            db.sql(f"CREATE OR REPLACE TEMP VIEW items AS SELECT g, (SELECT max(p.k) FROM (SELECT unnest(parts) AS p)) + 1 AS n, {starts} FROM rows_")
            db.sql("CREATE OR REPLACE TEMP TABLE parts AS SELECT g, p.k AS k, p.start AS start, p.state AS state, p.cost AS cost, p.path AS letters FROM (SELECT g, unnest(parts) AS p FROM rows_)")
        found = db.sql(f"SELECT key, piece, start::INT AS start, state::INT AS state, cost, path FROM ({ALONG if 'kinds' in t.column_names else ACROSS}) JOIN rows_ USING (g)").to_arrow_table()
        yield from found.cast(pa.schema([("key", pa.string()), ("piece", pa.int64()), ("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("path", pa.string())])).to_batches()


def _key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("1"), conv.cast("string")), F.lit("0"))


def keyed(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, conv, turn, role, text, tie): nulls set, and what the order goes by."""
    own = rows.select(_key(F.col(conv)).alias("key"), F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    return own.withColumn("tie", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def diagnose(rows: DataFrame) -> DataFrame:
    """Per conversation of ``keyed`` rows: key, n, gaps, blank, duplicate, truncated, illegal, cost, path (letters of the edits: R and I make users, r and i assistants), audit."""
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    first = F.substring("role", 1, 1)
    narrow = rows.select("key", "turn", "tie", F.when(first.isin(*"sua"), first).otherwise("x").alias("initial"), (~F.col("text").rlike(WORD)).alias("blank"), (~last.isin(*".!?")).alias("open"))
    at = placed(narrow, ["key"], ["turn", "tie"], write=materialise)
    # one row for each repeated text, so that the rows of one that repeats without end may be split
    again = at.groupBy("key", "tie").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    marked = at.join(again, ["key", "tie"], "left").withColumn("fault", F.when(F.col("blank"), "b").when(F.col("at") > F.col("first"), "d").when(F.col("open"), "t").otherwise(""))
    kind = F.when(F.col("fault").isin("b", "d"), "d").when(F.col("fault") == "t", F.upper("initial")).otherwise(F.col("initial"))
    piece = F.floor(F.col("at") / PIECE)
    # the last row of a piece also leads the next, so that pairs of neighbours are whole
    lead = (F.col("at") % PIECE == PIECE - 1) & (F.col("at") + 1 < F.col("size"))
    each = marked.select("key", "turn", "at", "initial", "fault", kind.alias("kind"), "size", F.explode(F.when(lead, F.array(piece, piece + 1)).otherwise(F.array(piece))).alias("piece")).withColumn("own", piece == F.col("piece"))
    rows_ = F.sort_array(F.collect_list(F.struct("at", "kind", "initial", "own")))
    count = lambda f: F.count_if(F.col("own") & (F.col("fault") == f))
    cut = each.groupBy("key", "piece", "size").agg(rows_.alias("rows"), count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"))
    names = F.array_join("rows.initial", "")
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.size("rows")), lambda i: F.substring(names, i, F.lit(2))), lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au"))
    kinds = F.array_join(F.transform(F.filter("rows", lambda r: r["own"]), lambda r: r["kind"]), "")
    pieces = materialise(cut.select("key", "piece", F.ceil(F.col("size") / PIECE).alias("pieces"), "size", kinds.alias("kinds"), F.size(pairs).cast("long").alias("illegal"), "blank", "duplicate", "truncated"))
    found = pieces.groupBy("key").agg(F.first("size").alias("n"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    turns = at.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    return found.join(turns, "key").join(audits(pieces), "key")


def audits(pieces: DataFrame) -> DataFrame:
    """(key, cost, path, audit) from (key, piece, pieces, kinds)."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    solve = lambda df: materialise(df.repartition(parts, "key", "piece").mapInArrow(_solved, ENTRIES))
    entries = solve(pieces.select("key", "piece", "kinds"))
    whole, left = entries, pieces.agg(F.max("pieces")).first()[0] or 1
    if left > 1:
        long = pieces.where("pieces > 1").select("key").distinct()
        whole, rest = entries.join(long, "key", "left_anti"), entries.join(long, "key", "left_semi")
        while left > 1:
            part = F.collect_list(F.struct((F.col("piece") % PIECE).alias("k"), "start", "state", "cost", "path")).alias("parts")
            rest = solve(rest.groupBy("key", F.floor(F.col("piece") / PIECE).alias("piece")).agg(part))
            left = -(-left // PIECE)
        whole = whole.unionByName(rest)
    # what is missing at the end is inserted
    end = F.when(F.col("state") == 1, "Ii").when(F.col("state") == 2, "i").otherwise("")
    done = whole.select("key", (F.col("cost") + F.length(end) * INSERT).alias("cost"), F.concat("path", end).alias("path"))
    best = F.min(F.struct("cost", F.upper("path").alias("audit"), "path"))
    return done.groupBy("key").agg(best.alias("b")).select("key", "b.cost", "b.path", "b.audit")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, place, role, text) of streams of a path and its rows."""
    key, path, at, place, out = None, "", 0, 0, []

    def add(role: str, text: str) -> None:
        nonlocal place
        out.append((key, place, role, text))
        place += 1

    def inserted() -> None:
        nonlocal at
        while at < len(path) and path[at] in "Ii":
            add("user" if path[at] == "I" else "assistant", "")
            at += 1

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        out.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["key", "place", "role", "text"])

    for b in batches:
        for k, p, role, text in zip(*[b.column(n).to_pylist() for n in ("key", "path", "role", "text")], strict=True):
            if p is not None:  # a conversation begins
                inserted()
                key, path, at, place = k, p, 0, 0
                continue
            inserted()
            if path[at] != "D":
                add({"R": "user", "r": "assistant"}.get(path[at], role), text)
            at += 1
        yield batch()
    inserted()
    yield batch()


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(key, place, role, text): the repaired rows, each conversation's together and in order, from ``keyed`` rows and (key, path)."""
    none = F.lit(None).cast("string")
    both = plan.select("key", F.lit(0).alias("tag"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), none.alias("tie"), "path", none.alias("role"), none.alias("text"))
    both = both.unionByName(rows.select("key", F.lit(1).alias("tag"), "turn", "tie", none.alias("path"), "role", "text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, "key").sortWithinPartitions("key", "tag", "turn", "tie").select("key", "path", "role", "text").mapInArrow(_edited, "key string, place bigint, role string, text string")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, h, out = None, None, []
    for b in batches:
        for k, role, text in zip(*[b.column(n).to_pylist() for n in ("key", "role", "text")], strict=True):
            if h is None or k != key:
                if h is not None:
                    out.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(f"{role}:{text}".encode())
        yield pa.record_batch([pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], names=["key", "sha"])
        out.clear()
    if h is not None:
        yield pa.record_batch([pa.array([key]), pa.array([h.hexdigest()])], names=["key", "sha"])


def digests(rows: DataFrame) -> DataFrame:
    """(key, sha): hex sha256 of the lines ``role:text`` of rows that ``repaired`` gives, whose order it relies on."""
    return rows.select("key", "role", "text").mapInArrow(_digested, "key string, sha string")


def repair_conversations(rows: DataFrame, every: DataFrame) -> DataFrame:
    """Per conversation id of ``every`` (conv_id): what ``diagnose`` tells of ``rows`` (conv_id, turn, role, text), and the repaired digest."""
    own = keyed(rows)
    found = materialise(diagnose(own))
    told = digests(repaired(own, found))
    ids = every.select(_key(F.col("conv_id")).alias("key"), "conv_id").distinct()
    whole = ids.join(found, "key", "left").join(told, "key", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return whole.select("conv_id", *[none(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by crc32 of conversation and turn: dropped, emptied, without stops, repeated, of another role."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    hit = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hit.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
