"""A Merkle manifest of a data set: one digest that every row's digest can be proved against.

Rows are leaves; the leaves of a group, in order, are folded by runs of ``fanout`` into their digest until one node, the
group's root, remains; the groups' roots, in order, are folded likewise into the root of all. The tree is built from the
bottom: each level is a table of runs (group, place, digest, children), written to the shared folder, and the next level
is a grouping of it. Proofs are pushed from the top: a level's runs are joined to the proof of each, and every child
takes its siblings in front of the proof that the run has. A proof is two arrays, the digests to the left and to the
right at each level, so it tells both what the siblings are and where the leaf stands among them. Only runs hold stored
proofs; those of leaves, sixteen times as many, are formed where they are used.

A group with a third of all rows is dealt by ranges of its order, and a run has at most ``fanout`` rows, so no group is
ever in one task.

Defined results: a null field counts as ``-``; a null group is a group of its own, before all others; null order values
come first; rows with equal order go by their digest, and equal rows have a leaf each; empty texts are values of no
bytes; a text of any length is hashed whole; an empty table gives no rows; extra columns are ignored, whatever they
are called. A lone leaf is its group's root, and a lone group's root is the root of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import materialise
from plumbline.operators.ranks import placed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16


def digest_of(*values: Column) -> Column:
    """Hex sha256 of fields, each written as its length in bytes, a colon and its value, or a dash where it is null."""
    one = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[one(v.cast("string")) for v in values]), 256)


def _longest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("size")).first()[0] or 0


def levels(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels above ``nodes`` (key, at, size, h, ...): rows (key, at, size, h, kids) with the children's columns in order. A group leaves once it is a single node."""
    found, left = [], _longest(nodes)
    while left > 1:
        kids = F.sort_array(F.collect_list(F.struct("at", *[c for c in nodes.columns if c not in ("key", "at", "size", "kids")])))
        runs = nodes.where("size > 1").groupBy("key", F.floor(F.col("at") / fanout).alias("up"), F.ceil(F.col("size") / fanout).alias("size")).agg(kids.alias("kids"))
        nodes = materialise(runs.select("key", F.col("up").alias("at"), "size", F.sha2(F.array_join("kids.h", ""), 256).alias("h"), "kids"))
        found.append(nodes)
        left = -(-left // fanout)
    return found


def tops(nodes: DataFrame, above: list[DataFrame]) -> DataFrame:
    """(key, top): the last node of each group, at whichever level it is."""
    found = nodes.where("size = 1").select("key", F.col("h").alias("top"))
    for level in above:
        found = found.unionByName(level.where("size = 1").select("key", F.col("h").alias("top")))
    return found


def _children(runs: DataFrame, proofs: DataFrame) -> DataFrame:
    """The children of runs, each with its siblings in front of the run's proof."""
    both = runs.select("key", "at", "kids").join(proofs, ["key", "at"])
    each = both.select(*[c for c in both.columns if c != "at"], F.posexplode("kids").alias("i", "kid"))
    h = F.col("kids.h")
    left, right = F.array_join(F.slice(h, F.lit(1), F.col("i")), ""), F.array_join(F.slice(h, F.col("i") + 2, F.size(h)), "")
    rest = [c for c in proofs.columns if c not in ("key", "at", "lefts", "rights")]
    return each.select("key", "kid.*", *rest, F.concat(F.array(left), "lefts").alias("lefts"), F.concat(F.array(right), "rights").alias("rights"))


def push(nodes: DataFrame, above: list[DataFrame], starts: DataFrame) -> DataFrame:
    """``nodes`` with the proof of each: ``lefts``, ``rights`` and the other columns of ``starts`` (key, lefts, rights, ...), which holds what each group's last node begins with."""
    more = [c for c in starts.columns if c != "key"]
    begun = lambda level: level.where("size = 1").join(starts, "key")
    at_level = None  # proofs of the level's nodes
    for n in range(len(above) - 1, -1, -1):
        proofs = begun(above[n]).select("key", "at", *more)
        if at_level is not None:
            proofs = proofs.unionByName(at_level.select("key", "at", *more))
        at_level = _children(above[n], materialise(proofs) if n else proofs)
    own = [c for c in nodes.columns if c != "size"]
    lone = begun(nodes).select(*own, *more)
    return lone if at_level is None else lone.unionByName(at_level.select(*own, *more))


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), leaf, lambda h, x: F.sha2(F.concat(x["l"], h, x["r"]), 256))


def merkle_manifest(docs: DataFrame, claims: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", fanout: int = FANOUT) -> DataFrame:
    """Per row: the order column, ``leaf``, ``subroot`` (of its group), ``root``, its proof (``lefts``, ``rights``, from the leaf up) and ``folded``, the root that the claimed fields lead to, which is ``root`` where they are the row's own.

    ``claims``: columns that stand in for fields of the rows as they are presented for the check.
    """
    if order == "leaf" or group == "leaf":
        raise ValueError("a column named leaf can't be the group or the order")
    own = digest_of(*[F.col(f) for f in fields])
    claims = claims or {}
    changed = F.lit(False)
    for f, claim in claims.items():
        changed = changed | ~claim.eqNullSafe(F.col(f))
    claimed = F.when(changed, digest_of(*[claims.get(f, F.col(f)) for f in fields]))
    # a text key that keeps the order of bytes, null first
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    leaves = docs.select(key.alias("key"), F.col(order).alias("id"), own.alias("h"), claimed.alias("claimed"))
    nodes = placed(leaves, ["key"], ["id", "h"], write=materialise)
    above = levels(nodes, fanout)
    groups = materialise(tops(nodes, above))
    roots = placed(groups.select("key", F.col("top").alias("h")), [], ["key"], write=materialise).select(F.lit("").alias("key"), "at", "size", "h", F.col("key").alias("group"))
    over = levels(roots, fanout)
    none = F.array().cast("array<string>")
    start = tops(roots, over).select("key", none.alias("lefts"), none.alias("rights"), F.col("top").alias("root"))
    starts = push(roots, over, start).select(F.col("group").alias("key"), "lefts", "rights", "root", F.col("h").alias("subroot"))
    proved = push(nodes, above, materialise(starts))
    return proved.select(F.col("id").alias(order), F.col("h").alias("leaf"), "subroot", "root", "lefts", "rights", folded(F.coalesce("claimed", "h"), F.col("lefts"), F.col("rights")).alias("folded"))


def proof_digest(lefts: Column, rights: Column) -> Column:
    """Hex sha256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(lefts, rights, lambda a, b: F.concat(a, b)), ""), 256)
