"""A manifest of a table: Merkle trees per group, a tree over the groups, and a proof per row.

Levels are strings.  An aligned block of ``WIDTH ** LEVELS`` neighbours holds its lowest level as
one string of hex digests, ``DIGEST`` characters each.  Its parents are the hashes of substrings of
fixed width, so a level above is made from the one below by SQL alone; a node's siblings are the
two substrings that flank it within its run.  A block's root is a node of the next round, which has
``WIDTH ** LEVELS`` times fewer rows, until one node is left per group.

Paths come back the other way: a block takes the segments above its root from the round above and
hands them to its rows together with its own.  A block holds a bounded number of nodes, whatever the
size of a group, and texts never leave the task that reads them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equivcheck.llm.common import let
from equivcheck.session import written

# Hex characters of a digest, and children of a node.
DIGEST = 64
WIDTH = 16

LEVELS = 2  # in a block: 256 nodes, 16 KB
BLOCK = WIDTH**LEVELS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(value: Column) -> Column:
    """``-`` for null, otherwise the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(values: Sequence[Column]) -> Column:
    """Hex SHA-256 of the encoded values, one after the other."""
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _name(group: Column) -> Column:
    """A group's name as a key that is never null and sorts with null first, then by bytes."""
    text = group.cast("string")
    return F.coalesce(F.concat(F.lit("="), text), F.lit(""))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``pos`` (from 0, along ``order`` within ``grp``) and ``n`` (rows of the group).

    Rows are dealt out by range, so a large group lies in many tasks; only counts per task and
    group go through a window.  Rows that are equal in ``order`` come in any order.
    """
    # ``any`` lets equal rows lie in several tasks.  The range is drawn from a table, not from texts.
    spread = written(rows.withColumn("any", F.xxhash64(F.monotonically_increasing_id())), "rows")
    along = ["grp", *[F.col(c).asc_nulls_first() for c in order], "any"]
    ranged = spread.repartitionByRange(*along).sortWithinPartitions(*along).drop("any")
    ranged = ranged.withColumn("at", F.monotonically_increasing_id())
    fixed = written(ranged.withColumn("part", F.shiftright("at", 33)), "ranged")
    parts = fixed.groupBy("grp", "part").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("held"))
    along = Window.partitionBy("grp").orderBy("part")
    before = F.sum("held").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")
    every = F.sum("held").over(Window.partitionBy("grp"))
    starts = parts.select("grp", "part", (before - F.col("start")).alias("shift"), every.alias("n"))
    placed = fixed.join(starts, ["grp", "part"])
    return placed.withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _piece(level: Column, start: Column, length: Column) -> Column:
    """A substring by places from 0; levels are bytes, so that it costs no walk from the start."""
    return F.substring(level, start + 1, length)


def _parents(level: Column) -> Column:
    """The level above: one digest for each run of children, the last run may be shorter."""
    runs = F.ceil(F.octet_length(level) / (DIGEST * WIDTH)).cast("int")
    hashed = F.transform(
        F.sequence(F.lit(0), runs - 1),
        lambda i: F.sha2(_piece(level, i * (DIGEST * WIDTH), F.lit(DIGEST * WIDTH)), 256),
    )
    return F.array_join(hashed, "").cast("binary")


def _blocks(nodes: DataFrame) -> DataFrame:
    """``(grp, blk, n, items, level0 .. , top)`` of nodes ``(grp, n, pos, node, item)``."""
    blk = F.floor(F.col("pos") / BLOCK).cast("long")
    held = F.sort_array(F.collect_list(F.struct("pos", "node", "item")))
    blocks = nodes.groupBy("grp", blk.alias("blk")).agg(F.first("n").alias("n"), held.alias("held"))
    level = F.array_join(F.transform("held", lambda x: x["node"]), "").cast("binary")
    items = F.transform("held", lambda x: x["item"])
    blocks = blocks.select("grp", "blk", "n", items.alias("items"), level.alias("level0"))
    top = F.col("level0")
    for k in range(1, LEVELS + 1):
        # A level has a parent as long as its group has more than one node there.
        more = F.col("n") > WIDTH ** (k - 1)
        blocks = blocks.withColumn(f"level{k}", F.when(more, _parents(F.col(f"level{k - 1}"))))
        top = F.coalesce(F.col(f"level{k}"), top)
    return blocks.withColumn("top", top.cast("string"))


def _flanks(level: Column, above: Column, index: Column) -> Column:
    """Siblings left and right of the node at ``index`` of its level, if the level has one above."""
    run = F.floor(index / WIDTH).cast("int") * (WIDTH * DIGEST)
    own = index * DIGEST
    end = F.least(run + WIDTH * DIGEST, F.octet_length(level))
    left, right = _piece(level, run, own - run), _piece(level, own + DIGEST, end - own - DIGEST)
    return F.when(above.isNotNull(), F.array(F.struct(left.alias("left"), right.alias("right"))))


def _opened(blocks: DataFrame, *more: str) -> DataFrame:
    """The nodes of blocks with ``path``: their siblings level by level, then those of their block."""
    each = blocks.select("*", F.posexplode("items").alias("i", "item"))
    steps, index = [], F.col("i")
    for k in range(LEVELS):
        steps.append(F.coalesce(_flanks(F.col(f"level{k}"), F.col(f"level{k + 1}"), index), F.array()))
        index = F.floor(index / WIDTH).cast("int")
    path = F.concat(*steps, F.col("upper"))
    node = _piece(F.col("level0"), F.col("i") * DIGEST, F.lit(DIGEST)).cast("string")
    pos = F.col("blk") * BLOCK + F.col("i")
    return each.select("grp", pos.alias("pos"), node.alias("node"), "item", path.alias("path"), *more)


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of all rounds, the rows' own first; the last has one block for each group."""
    rounds = []
    while True:
        blocks = written(_blocks(nodes), "blocks")
        rounds.append(blocks)
        if not blocks.where(F.col("n") > BLOCK).take(1):
            return rounds
        ends = blocks.where(F.col("n") > BLOCK)
        n = F.ceil(F.col("n") / BLOCK).cast("long").alias("n")
        none = F.lit(None).cast("string").alias("item")
        nodes = ends.select("grp", n, F.col("blk").alias("pos"), F.col("top").alias("node"), none)


def _paths(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Opens all rounds from the last to the first.

    ``tops`` has ``(grp, upper, ...)`` of every group: the path above its root, and columns that all
    of its rows get.
    """
    more = [c for c in tops.columns if c not in ("grp", "upper")]
    last = tops.withColumn("blk", F.lit(0).cast("long"))
    for depth in range(len(rounds) - 1, -1, -1):
        # A group ends in the first round that holds it in one block.
        here = rounds[depth].where(F.col("n") <= BLOCK).join(last, ["grp", "blk"])
        if depth + 1 < len(rounds):
            above = opened.select("grp", F.col("pos").alias("blk"), F.col("path").alias("upper"), *more)
            here = here.unionByName(rounds[depth].where(F.col("n") > BLOCK).join(above, ["grp", "blk"]))
        opened = _opened(here, *more)
    return opened


def _roots(rounds: list[DataFrame]) -> DataFrame:
    """``(grp, root)`` of every group."""
    done = [r.where(F.col("n") <= BLOCK).select("grp", F.col("top").alias("root")) for r in rounds]
    return reduce(DataFrame.unionByName, done)


def _folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    parent = lambda node, step: F.sha2(F.concat(step["left"], node.cast("binary"), step["right"]), 256)
    return F.aggregate(path, leaf, parent)


def _proof(path: Column) -> Column:
    """The hash of all siblings, level by level and left to right."""
    hexes = F.transform(path, lambda s: F.concat(s["left"], s["right"]).cast("string"))
    return F.sha2(F.array_join(hexes, "").cast("binary"), 256)


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "source",
    id_column: str = "doc_id",
    tampered: dict[str, Column] | None = None,
) -> DataFrame:
    """``(id, grp, leaf, subroot, root, path, proof, folded_root, verified)`` of every row of ``docs``.

    A leaf is the digest of ``fields``.  Leaves of a group ascend by id (null first), rows of one id
    by their leaf.  ``path`` lists the siblings (left, right) from the leaf to the root over all
    groups, ``proof`` is their hash.  ``tampered`` replaces fields by expressions over ``docs``:
    ``folded_root`` is worked out again from such a leaf and the siblings of the untampered table, and
    ``verified`` says whether it is the root.  Without ``tampered`` every row verifies.

    A null group is a group of its own, before all others; null and empty values differ; repeated rows
    are leaves of their own.  Values count in full, however long.  Columns that are not in ``fields``
    have no influence, whatever their names.  An empty table gives no rows.
    """
    now = {f: F.col(f"`{f}`") for f in fields}
    other = now | (tampered or {})
    leaf = digest(list(now.values()))
    claimed = digest([other[f] for f in fields]) if tampered else leaf
    leaves = docs.select(
        _name(F.col(f"`{group}`")).alias("grp"),
        F.col(f"`{id_column}`").alias("id"),
        leaf.alias("node"),
        claimed.alias("claimed"),
    )
    leaves = numbered(leaves, ["id", "node"])
    # Rows keep what is theirs only: the id, and another leaf where there is one.
    item = F.struct("id", F.when(F.col("claimed") != F.col("node"), F.col("claimed")).alias("claimed"))
    rounds = _rounds(leaves.select("grp", "n", "pos", "node", item.alias("item")))

    subroots = written(_roots(rounds), "subroots")
    groups = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("item"), F.col("root").alias("node"))
    above = _rounds(numbered(groups, ["item"]).select("grp", "n", "pos", "node", "item"))
    root = _roots(above).select("grp", "root", F.array().cast("array<struct<left:binary,right:binary>>").alias("upper"))
    tops = _paths(above, root)
    tops = tops.select(F.col("item").alias("grp"), F.col("node").alias("subroot"), "root", F.col("path").alias("upper"))

    rows = _paths(rounds, written(tops, "tops"))
    folded = _folded(F.coalesce("item.claimed", "node"), F.col("path"))
    rows = rows.select(
        F.col("item.id").alias("id"),
        "grp",
        F.col("node").alias("leaf"),
        "subroot",
        "root",
        "path",
        _proof(F.col("path")).alias("proof"),
        folded.alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_text(by: int = 5) -> dict[str, Column]:
    """Lower-cases A-Z in the text of every row whose id's crc32 ``by`` divides; null ids are left."""
    chosen = let(F.crc32(F.col("doc_id").cast("string").cast("binary")), lambda c: c % by == 0)
    return {"text": F.when(chosen, lower_ascii(F.col("text"))).otherwise(F.col("text"))}
