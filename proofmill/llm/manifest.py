"""Merkle manifest of a dataset: a tree for each group of rows, one tree over the groups' roots.

Checkpoint and recompute: of each tree only every ``EVERY``-th level is stored, as packed blocks of
the nodes that share one stored ancestor. A proof regenerates the levels in between from a stored
block, hands the siblings on and forgets them. No block holds more than FANOUT**EVERY nodes, so a
group of any size is spread over tasks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.tables import Scratch

#: Children of a node; levels from one stored level to the next; nodes of a block.
FANOUT, EVERY = 16, 2
BLOCK = FANOUT**EVERY
#: Blocks whose paths are broadcast at most (about 4 KB each); more are shuffled.
SMALL = 10_000

_STEPS = "array<struct<pre:string,post:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of all parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and its text; ``-`` if null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hashed(nodes: Column) -> Column:
    """The parents of consecutive nodes, of which the first is a first child."""
    firsts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(firsts, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, F.lit(FANOUT)), ""), 256))


def _height() -> Column:
    """Levels from a stored one up to the next stored one, or to the root: none for a lone node."""
    out = F.lit(EVERY)
    for h in reversed(range(EVERY)):
        out = F.when(F.col("count") <= FANOUT**h, h).otherwise(out)
    return out


def _grown(blocks: DataFrame) -> DataFrame:
    """Blocks with the levels in between, ``level_0`` to ``level_EVERY``, regenerated."""
    out = blocks.withColumn("level_0", F.transform("nodes", lambda x: x["digest"]))
    for i in range(EVERY):
        out = out.withColumn(f"level_{i + 1}", _hashed(F.col(f"level_{i}")))
    return out


def _parents(blocks: DataFrame) -> DataFrame:
    """The nodes of the next stored level: ``tree, pos, digest``, and ``count``, how many there are in the tree."""
    top = F.get(F.array(*[F.element_at(f"level_{i}", 1) for i in range(EVERY + 1)]), _height())
    count = F.when(F.col("count") <= BLOCK, 1).otherwise(F.ceil(F.col("count") / BLOCK)).cast("bigint")
    return _grown(blocks).select("tree", F.col("block").alias("pos"), top.alias("digest"), count.alias("count"))


def _packed(nodes: DataFrame, payload: list[str]) -> DataFrame:
    one = F.struct("pos", "digest", *payload)
    grouped = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block"), "count")
    return grouped.agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["pos"] < b["pos"], -1).otherwise(1)).alias("nodes"))


def numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``pos``, the place within their ``tree`` from 0, nulls first, and ``count``, the tree's rows.

    Rows are dealt out by range and sorted there; what earlier ranges hold of a tree is added from
    their totals. No tree is ever in one task.
    """
    by = [F.asc_nulls_first(c) for c in ("tree", *order)]
    dealt = scratch.cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    totals = dealt.groupBy("tree", part.alias("range")).agg(F.min("at").alias("start"), F.count("*").alias("n"))
    own = Window.partitionBy("tree")
    earlier = F.coalesce(F.sum("n").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = scratch.cut(totals.select("tree", "range", (earlier - F.col("start")).alias("shift"), F.sum("n").over(own).alias("count")))
    offsets = F.broadcast(offsets) if offsets.count() <= SMALL else offsets
    return dealt.withColumn("range", part).join(offsets, ["tree", "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("range", "at", "shift")


class Trees(NamedTuple):
    """Stored levels from the leaves up (``tree, block, count, nodes``), and the root of each tree (``tree, digest``)."""

    levels: list[DataFrame]
    roots: DataFrame


def grow(nodes: DataFrame, payload: list[str], scratch: Scratch) -> Trees:
    """All stored levels over ``tree, pos, count, digest`` and the leaves' ``payload``."""
    levels, ended = [scratch.cut(_packed(nodes, payload))], []
    while True:
        up = scratch.cut(_parents(levels[-1]))
        ended.append(up.where("count = 1"))
        if not (up.agg(F.max("count")).first()[0] or 1) > 1:
            break
        levels.append(scratch.cut(_packed(up.where("count > 1"), [])))
    roots = ended[0]
    for more in ended[1:]:
        roots = roots.unionByName(more)
    return Trees(levels, roots.select("tree", "digest"))


def _steps(above: DataFrame, blocks: DataFrame, payload: list[str]) -> DataFrame:
    """A row for each node of the blocks: ``tree, pos, digest``, payload, and ``above`` with the steps of its own block in front.

    ``above`` (``tree, block, above``) holds the steps from each block's stored ancestor to the root.
    """
    joined = _grown(blocks.join(above, ["tree", "block"])).withColumn("height", _height())
    own = joined.select("*", F.posexplode("nodes").alias("j", "node"))
    steps = []
    for i in range(EVERY):
        at = F.floor(F.col("j") / FANOUT**i).cast("int")
        first = at - at % FANOUT
        siblings = lambda start, n, i=i: F.array_join(F.slice(f"level_{i}", start + 1, n), "")
        steps.append(F.struct(siblings(first, at - first).alias("pre"), siblings(at + 1, first + FANOUT - 1 - at).alias("post")))
    path = F.concat(F.slice(F.array(*steps), F.lit(1), F.col("height")), F.col("above.steps"))
    return own.select("tree", F.col("node.pos").alias("pos"), F.col("node.digest").alias("digest"), *[f"node.{c}" for c in payload], F.struct(path.alias("steps"), F.col("above.subroot").alias("subroot")).alias("above"))


def proofs(trees: Trees, roots: DataFrame, payload: list[str]) -> DataFrame:
    """A row for each leaf: ``tree, pos, digest``, payload, ``above`` (``steps`` from leaf to root, ``subroot``).

    ``roots`` has ``tree, above``: the steps from each tree's root. Stored levels are read from the
    top down; each block gets the path of its ancestor and makes those of its nodes.
    """
    paths = None
    for k in reversed(range(len(trees.levels))):
        blocks = trees.levels[k]
        ends = blocks.where(F.col("count") <= BLOCK).select("tree", "block").join(roots, "tree")
        above = ends if paths is None else ends.unionByName(paths.select("tree", F.col("pos").alias("block"), "above"))
        above = F.broadcast(above) if blocks.count() <= SMALL else above
        paths = _steps(above, blocks, payload if k == 0 else [])
    return paths


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda h, s: digest(s["pre"], h, s["post"]))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings, level by level from the leaf up, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["pre"], s["post"])), ""))


def manifest(docs: DataFrame, group: str = "source", key: str = "doc_id", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """``key, leaf, subroot, root, steps, tampered_leaf`` for every row of ``docs``.

    A leaf is the digest of its fields, each by ``field``. Leaves of a group ascend by key, null keys
    first, rows of one key by leaf; every FANOUT consecutive nodes have one parent while there are
    several, and so have the roots of the groups, null first, then in order of UTF-8 bytes. ``steps``
    are the siblings before and after a node, level by level up to the root. ``tampered`` replaces
    fields of the rows that ``where`` names; ``tampered_leaf`` is the digest of what results there,
    else null. Repeated rows are leaves of their own; other columns of ``docs`` play no part; an
    empty table has no rows.
    """
    scratch, early = Scratch(), Scratch()
    columns = {c: F.col(c) for c in fields}
    leaf = digest(*map(field, columns.values()))
    other = F.lit(None).cast("string")
    if tampered:
        other = F.when(F.lit(True) if where is None else where, digest(*[field(tampered.get(c, columns[c])) for c in fields]))
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # a null group is before all others
    leaves = early.cut(docs.select(F.col(key).alias("key"), tree.alias("tree"), leaf.alias("digest"), other.alias("tampered")))
    groups = grow(numbered(leaves, ["key", "digest"], early), ["key", "tampered"], scratch)
    early.clear()
    named = groups.roots.withColumnRenamed("tree", "group").withColumn("tree", F.lit(""))
    whole = grow(numbered(named, ["group"], scratch), ["group"], scratch)
    root = whole.roots.first()
    top = F.struct(F.array().cast(_STEPS).alias("steps"), F.lit(None).cast("string").alias("subroot"))
    roots = proofs(whole, whole.roots.select("tree", top.alias("above")), ["group"])
    roots = roots.select(F.col("group").alias("tree"), F.struct(F.col("above.steps").alias("steps"), F.col("digest").alias("subroot")).alias("above"))
    out = proofs(groups, roots, ["key", "tampered"])
    return out.select(F.col("key").alias(key), F.col("digest").alias("leaf"), F.col("above.subroot").alias("subroot"), F.lit(root["digest"] if root else None).cast("string").alias("root"), F.col("above.steps").alias("steps"), F.col("tampered").alias("tampered_leaf"))
