"""Mixing sources to target weights by hierarchical budgets.

A tree of levels (domain, language, source, say) has weights on all nodes.  The budget, in tokens,
runs down from the root: children share their parent's budget by weight, a child whose supply is
less than its share gives the rest to its siblings, and only what all siblings together cannot
supply goes up to the parent's own siblings.  As a node never gets more than its leaves can supply,
this is one water-filling per parent, solved in closed form by a window over the parent's children
(sorted by supply per weight; whole numbers only, leftover tokens go to the first of equals).

A leaf fills its budget from seeded epochs: whole passes over its documents as often as they fit
(at most ``epochs`` in all), and from the next pass the longest prefix, in the order of md5 of
seed, epoch and id, that stays within the budget.  To find the prefix no leaf is sorted: token sums
per hash slice (the first ``SLICE`` hex digits) say in which slice it ends, and only that slice is
scanned by row.  Documents equal in hash and id are taken together or not at all.

Only built-in expressions.  Texts are never shuffled: the last pass reads the documents, joins the
table of leaves and filters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equivcheck.llm.common import SPACES
from equivcheck.session import written

SLICE = 4  # hex digits: 65,536 slices of a leaf
LEAVES = 20_000  # a table of so many leaves may be broadcast: some 4 MB
WEIGHT = 1_000  # weight of a node without a weight of its own


def tokens(text: Column) -> Column:
    """Words of a text, counted without an array."""
    gaps = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "a")
    return F.length(F.regexp_replace(gaps, SPACES, "")).cast("long")


def _order(seed: int, epoch: Column, doc_id: Column) -> Column:
    label = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.md5(label.cast("binary"))


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Water-filling among the children of each parent: adds ``budget`` to ``supply``, ``weight``.

    ``given`` is the parent's budget, never above the children's supply.  A child is full if its
    supply is within its share of what the fuller ones leave.
    """
    big = "decimal(38,0)"
    ratio = F.col("supply").cast("double") / F.col("weight")
    up = Window.partitionBy(*parent).orderBy(ratio, name)
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    placed = nodes.withColumn("__taken", F.coalesce(F.sum("supply").over(before), zero)).withColumn(
        "__weights", F.sum("weight").over(after)
    )
    left = F.col("given").cast(big) - F.col("__taken").cast(big)
    fits = F.col("supply").cast(big) * F.col("__weights").cast(big) <= left * F.col("weight").cast(big)
    full = placed.withColumn("__full", fits)
    # Full children stand first; once one is not full, none after it is.
    full = full.withColumn(
        "__full", F.min(F.col("__full").cast("int")).over(up.rowsBetween(Window.unboundedPreceding, 0)) == 1
    )
    whole = Window.partitionBy(*parent)
    full = full.withColumn(
        "__rest",
        F.col("given") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("supply"))).over(whole), zero),
    ).withColumn("__sum", F.sum(F.when(~F.col("__full"), F.col("weight"))).over(whole))
    part = (F.col("__rest").cast(big) * F.col("weight").cast(big)).cast(big)
    floor = ((part - F.pmod(part, F.col("__sum").cast(big))) / F.col("__sum").cast(big)).cast("long")
    shared = full.withColumn("__floor", F.when(F.col("__full"), F.col("supply")).otherwise(floor))
    over = F.col("given") - F.sum("__floor").over(whole)
    rank = F.row_number().over(Window.partitionBy(*parent, "__full").orderBy(name))
    shared = shared.withColumn("__over", over).withColumn("__rank", rank)
    extra = (~F.col("__full") & (F.col("__rank") <= F.col("__over"))).cast("int")
    budget = (F.col("__floor") + extra).alias("budget")
    return shared.select(*nodes.columns, budget)


def budgets(
    leaves: DataFrame,
    levels: Sequence[str],
    total: int,
    weights: dict[str, dict[str, int]] | None = None,
) -> DataFrame:
    """Adds ``budget`` to a table of leaves with ``levels`` and ``supply`` (tokens, long).

    ``weights`` names, per level, whole positive weights of its values; others have ``WEIGHT``.
    A total above the supply is cut to the supply.
    """
    nodes = {}
    for depth in range(1, len(levels) + 1):
        path = list(levels[:depth])
        node = leaves.groupBy(*path).agg(F.sum("supply").alias("supply"))
        weight = F.lit(WEIGHT)
        for value, w in (weights or {}).get(levels[depth - 1], {}).items():
            weight = F.when(F.col(levels[depth - 1]) == value, F.lit(w)).otherwise(weight)
        nodes[depth] = node.withColumn("weight", weight.cast("long"))
    every = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("all"))
    given = every.select(F.least(F.col("all"), F.lit(int(total)).cast("long")).alias("given"))
    # One row, the total: the only join without a key.
    now = _share(nodes[1].crossJoin(F.broadcast(given)), [], levels[0])
    for depth in range(2, len(levels) + 1):
        parent = list(levels[: depth - 1])
        above = now.select(*parent, F.col("budget").alias("given"))
        now = _share(nodes[depth].join(above, parent), parent, levels[depth - 1])
    return now.select(*levels, "supply", "budget")


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    total: int | None = None,
    share: tuple[int, int] = (1, 2),
    weights: dict[str, dict[str, int]] | None = None,
    epochs: int = 4,
    seed: int = 7,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The documents of the mixture, each as often as it is drawn, with ``epoch`` (from 0).

    ``levels`` gives the tree, top first, as expressions over ``docs``; null is a value of its own,
    the empty text.  The budget is ``total`` tokens, or ``share`` of all tokens.  Documents without
    tokens cost nothing and come once per whole pass.  An empty table gives no rows.  Columns may have
    any names; one called ``epoch`` is replaced.
    """
    names = [f"__{name}" for name in levels]
    keys = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values(), strict=True)]
    narrow = written(
        docs.select(F.col(f"`{id_column}`").alias("__id"), *keys, tokens(F.col(f"`{text}`")).alias("__tokens")), "tokens"
    )
    sums = written(narrow.groupBy(*names).agg(F.sum("__tokens").alias("held")), "leaves")
    held = sums.agg(F.coalesce(F.sum("held"), F.lit(0)), F.count(F.lit(1))).first()
    total = held[0] * share[0] // share[1] if total is None else total
    supply = sums.withColumn("supply", F.col("held") * epochs)
    named = {f"__{k}": v for k, v in (weights or {}).items()}
    shares = budgets(supply, names, total, named)
    held_tokens = F.greatest(F.col("supply") / epochs, F.lit(1)).cast("long")
    whole = F.when(F.col("supply") == 0, F.lit(1)).otherwise(F.floor(F.col("budget") / held_tokens)).cast("long")
    leaf = shares.withColumn("__whole", whole).withColumn(
        "__left", F.when(F.col("supply") == 0, F.lit(0)).otherwise(F.col("budget") - F.col("__whole") * held_tokens)
    )
    leaf = written(leaf.select(*names, "budget", "__whole", "__left"), "budgets")
    small = held[1] <= LEAVES

    def with_leaf(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(leaf) if small else leaf, names)

    ordered = with_leaf(narrow).withColumn("__hash", _order(seed, F.col("__whole"), F.col("__id")))
    sliced = ordered.withColumn("__slice", F.substring("__hash", 1, SLICE))
    slices = sliced.groupBy(*names, "__slice", "__left").agg(F.sum("__tokens").alias("n"))
    up = Window.partitionBy(*names).orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)
    running = slices.withColumn("__upto", F.sum("n").over(up))
    # The first slice that does not fit as a whole is scanned by row; those before it are taken.
    ends = (
        running.where(F.col("__upto") > F.col("__left"))
        .groupBy(*names)
        .agg(F.min("__slice").alias("__end"), F.min(F.col("__upto") - F.col("n")).alias("__before"))
    )
    ends = written(ends, "ends")
    last = sliced.join(ends.withColumnRenamed("__end", "__slice"), [*names, "__slice"])
    peers = Window.partitionBy(*names).orderBy("__hash", "__id").rangeBetween(Window.unboundedPreceding, 0)
    fits = last.withColumn("__sum", F.sum("__tokens").over(peers) + F.col("__before"))
    fits = fits.where(F.col("__sum") <= F.col("__left"))
    mark = fits.groupBy(*names).agg(F.max(F.struct("__hash", F.col("__id"))).alias("__last"))
    cut = leaf.join(ends.select(*names, "__end"), names, "left").join(mark, names, "left")
    cut = written(cut, "cuts")
    # The row travels whole, so that its columns may have the names of others.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "epoch"]).alias("__row")
    rows = docs.select(row, F.col(f"`{id_column}`").alias("__id"), *keys)
    rows = rows.join(F.broadcast(cut) if small else cut, names)
    here = F.struct(_order(seed, F.col("__whole"), F.col("__id")).alias("__hash"), "__id")
    first_part = F.substring(here["__hash"], 1, SLICE)
    # Nothing left to draw: no prefix, not even of documents without tokens.
    inside = F.when(F.col("__end").isNull() | (F.col("__left") == 0), F.lit(False)).otherwise(
        (first_part < F.col("__end")) | F.coalesce(here <= F.col("__last"), F.lit(False))
    )
    times = F.col("__whole") + inside.cast("int")
    drawn = rows.withColumn("__times", times.cast("int")).where("__times > 0")
    epoch = F.explode(F.sequence(F.lit(0), F.col("__times") - 1)).alias("epoch")
    return drawn.select("__row.*", epoch)
