"""Comparison of two results as bags of rows.

The exact part is one aggregation: every row of either side adds to a count per
distinct row, and two equal bags leave no count uneven.  Rows that occur very
often are counted before the shuffle, so no copy group is ever gathered.

The tolerant part runs only where the exact one finds a difference and there
are floating-point columns.  Within each group of equal exact columns it pairs
the k-th smallest value of one side with the k-th smallest of the other; for one
floating-point column this finds a pairing within tolerance whenever there is
one.  With several it takes a matching (``plans.pairing``).  Counts stay counts: a
value that occurs a billion times is one run of ranks.  Groups of any size are
scanned in blocks (``operators.scan``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equivcheck import types
from equivcheck.operators.scan import running
from equivcheck.plans import pairing
from equivcheck.session import shuffle_partitions, written

# Verdict names, and the absolute tolerance for floats.
EQUAL, REORDERED, DIFF, ERROR = "Equal", "Reordered", "Diff", "Error"
ATOL = 1e-3

RTOL = 1e-9
GROUP_LIMIT = 1_000_000


@dataclass(frozen=True)
class Verdict:
    """``differing`` counts rows without an exact partner on the other side.

    ``tolerant`` marks results that agree only within tolerance.  Verdicts are certain, ``maybe`` is
    never set; the column is kept as stored tables have it.
    """

    relation: str
    left_rows: int | None = None
    right_rows: int | None = None
    differing: int | None = None
    tolerant: bool = False
    maybe: bool = False
    reason: str | None = None


def close(a: Column, b: Column, atol: float = ATOL, rtol: float = RTOL) -> Column:
    """Equal, or two finite numbers that differ by less than the tolerance.

    NULL is close to NULL and NaN to NaN; an infinity only to itself.
    """
    gap = F.abs(a - b)
    finite = [~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) for c in (a, b)]
    near = finite[0] & finite[1] & (
        (gap < F.lit(atol)) | (gap <= F.lit(rtol) * F.greatest(F.abs(a), F.abs(b)))
    )
    return a.eqNullSafe(b) | F.coalesce(near, F.lit(False))


def schema_conflict(left: DataFrame, right: DataFrame) -> str | None:
    """Column classes must agree in order; names are not looked at."""
    a = [types.value_class(f.dataType) for f in left.schema]
    b = [types.value_class(f.dataType) for f in right.schema]
    return None if a == b else f"column classes differ: {a} against {b}"


def _counted(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per distinct row: columns ``c0, c1, ...`` and its counts ``nl`` and ``nr``."""
    shared = [
        types.common_type(a.dataType, b.dataType) for a, b in zip(left.schema, right.schema)
    ]
    names = [f"c{i}" for i in range(len(shared))]

    def side(df: DataFrame, nl: int, nr: int) -> DataFrame:
        return df.toDF(*names).select(
            *[F.col(n).cast(t).alias(n) for n, t in zip(names, shared)],
            F.lit(nl).cast("bigint").alias("nl"),
            F.lit(nr).cast("bigint").alias("nr"),
        )

    both = side(left, 1, 0).unionAll(side(right, 0, 1))
    return both.groupBy(*names).agg(F.sum("nl").alias("nl"), F.sum("nr").alias("nr"))


def _uneven() -> Column:
    return F.abs(F.col("nl") - F.col("nr"))


def compare(
    left: DataFrame,
    right: DataFrame,
    pos: str | None = None,
    atol: float = ATOL,
    rtol: float = RTOL,
    group_limit: int = GROUP_LIMIT,
) -> Verdict:
    """Relation of two results.

    Frames have no order.  With ``pos`` naming a position column on both sides
    the order counts: ``Equal`` needs equal positions, equal rows at other
    positions are ``Reordered``.  Without it equal bags are ``Equal``.
    """
    conflict = schema_conflict(left, right)
    if conflict:
        return Verdict(ERROR, left.count(), right.count(), reason=conflict)

    if pos is not None:
        # position last, so that the columns in front are those of the plain bag
        values = [c for c in left.columns if c != pos]
        right_values = [c for c in right.columns if c != pos]
        placed = _counted(left.select(*values, pos), right.select(*right_values, pos))
        left, right = left.select(*values), right.select(*right_values)
        bag = placed.groupBy(*[f"c{i}" for i in range(len(values))]).agg(
            F.sum("nl").alias("nl"), F.sum("nr").alias("nr"), F.sum(_uneven()).alias("moved")
        )
    else:
        bag = _counted(left, right).withColumn("moved", F.lit(0).cast("bigint"))
    row = bag.agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(name)
            for name, c in {
                "left": F.col("nl"),
                "right": F.col("nr"),
                "differing": _uneven(),
                "moved": F.col("moved"),
            }.items()
        ]
    ).first()

    counts = {"left_rows": row.left, "right_rows": row.right, "differing": row.differing}
    if row.differing == 0:
        return Verdict(EQUAL if row.moved == 0 else REORDERED, **counts)
    floats = [i for i, f in enumerate(left.schema) if types.is_float(f.dataType)]
    if row.left != row.right or not floats:
        return Verdict(DIFF, **counts)
    paired = pairs_within_tolerance(_counted(left, right), floats, atol, rtol, group_limit)
    if paired:
        return Verdict(REORDERED, tolerant=True, **counts)
    return Verdict(DIFF, **counts)


def _in_blocks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``block``: range partitions, as many as the session shuffles into.

    Writing them down fixes their bounds.
    """
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys, *order)
    return written(ranged.withColumn("block", F.spark_partition_id()), "ranges")


def _clustered(
    bag: DataFrame,
    exact: list[str],
    near: list[str],
    atol: float,
    rtol: float,
    blocked: bool,
) -> tuple[DataFrame, list[str]]:
    """Add a cluster number per floating-point column; no two close rows are in different clusters.

    A column's clusters end where the next value is not close to the one before, among rows that
    agree in the exact columns and in the clusters of all other columns; repeated until no
    cluster is cut any more.
    """
    marks = [f"k{i}" for i in range(len(near))]
    now = bag.withColumns({m: F.lit(0).cast("bigint") for m in marks})
    before, block = 0, "block" if blocked else None
    while True:
        for mark, c in zip(marks, near, strict=True):
            group = [*exact, *[m for m in marks if m != mark]]
            rest = now.drop(mark)
            rest = _in_blocks(rest, group, [c]) if blocked else rest
            last = running(rest, group, [c], {"last": ("max_before", c)}, block)
            # A little wider than the tolerance, as relative bounds differ along a chain.
            gap = ~close(F.col(c), F.col("last"), atol * 1.001, rtol * 1.001)
            cut = last.withColumn("cut", gap.cast("bigint")).drop("last")
            now = running(cut, group, [c], {mark: ("sum", "cut")}, block).drop("cut", "block")
            now = written(now, "clusters") if blocked else now
        now = now if blocked else written(now, "clusters")
        found = now.select(*exact, *marks).distinct().count()
        if len(near) == 1 or found == before:
            return now, marks
        before = found


def pairs_within_tolerance(
    bag: DataFrame, floats: list[int], atol: float, rtol: float, group_limit: int
) -> bool:
    """Whether the rows of both sides can be paired off within tolerance.

    With one floating-point column equal ranks are close in every group of equal exact columns if
    there is a pairing at all; with several it takes a matching (``plans.pairing``).
    """
    bag = written(bag, "bag")
    near = [f"c{i}" for i in floats]
    exact = [c for c in bag.columns if c.startswith("c") and c not in near]

    def by_rank(df: DataFrame, groups: list[str], order: list[str]) -> bool:
        sizes = df.groupBy(*groups).agg(
            F.count(F.lit(1)).alias("n"), F.sum("nl").alias("nl"), F.sum("nr").alias("nr")
        )
        stats = sizes.agg(F.max("n").alias("largest"), F.sum(_uneven()).alias("uneven")).first()
        if stats.uneven:
            return False
        blocked = not groups or (stats.largest or 0) > group_limit
        return _far_ranks(df, groups, order, atol, rtol, group_limit, blocked).isEmpty()

    if len(near) == 1:
        return by_rank(bag, exact, near)
    limit = min(group_limit, pairing.LIMIT)
    return pairing.paired(
        bag, exact, near, atol, rtol, lambda a, b: close(a, b, atol, rtol), by_rank, limit
    )


def _far_ranks(
    bag: DataFrame,
    exact: list[str],
    order: list[str],
    atol: float,
    rtol: float,
    group_limit: int,
    blocked: bool,
) -> DataFrame:
    """Ranks at which the rows of both sides, put in order, are not close."""
    if blocked:
        bag = _in_blocks(bag, exact, order)
    ranked = running(
        bag,
        exact,
        order,
        {"upto_l": ("sum", "nl"), "upto_r": ("sum", "nr")},
        "block" if blocked else None,
    )

    # A row is a run of ranks on each side it occurs on.  Between two run starts
    # the value of either side stays the same.  A single column is held plain: NULL comes first
    # in its order and no maximum after it falls back to it.
    plain = len(order) == 1
    value = F.col(order[0]) if plain else F.struct(*order)
    empty = F.lit(None).cast(bag.select(value.alias("v")).schema["v"].dataType)
    runs = ranked.select(
        *exact,
        F.inline(
            F.array(
                *[
                    F.struct(
                        (F.col(f"upto_{s}") - F.col(f"n{s}")).alias("rank"),
                        F.col(f"n{s}").alias("n"),
                        (value if s == "l" else empty).alias("lv"),
                        (value if s == "r" else empty).alias("rv"),
                    )
                    for s in ("l", "r")
                ]
            )
        ),
    ).where("n > 0")
    starts = runs.groupBy(*exact, "rank").agg(F.max("lv").alias("lv"), F.max("rv").alias("rv"))
    if blocked:
        starts = starts.withColumn("stretch", F.floor(F.col("rank") / F.lit(group_limit)))
    held = running(
        starts,
        exact,
        ["rank"],
        {"left_value": ("max", "lv"), "right_value": ("max", "rv")},
        "stretch" if blocked else None,
    )

    def sides(c: str) -> list[Column]:
        return [F.col(s if plain else f"{s}.{c}") for s in ("left_value", "right_value")]

    condition = F.lit(False)
    for c in order:
        condition = condition | ~close(*sides(c), atol, rtol)
    return held.where(condition)


def diff_rows(
    left: DataFrame,
    right: DataFrame,
    atol: float | None = None,
    rtol: float = RTOL,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Rows without a partner: ``side`` that has more of them, by how many, and the row.

    Partners are equal, or with ``atol`` also within tolerance: of the rows without an equal
    partner those close to each other are set off against each other, and what one side has more
    is listed.  Where a chain of close values is as a whole wider than the tolerance all its rows
    are listed.
    """
    conflict = schema_conflict(left, right)
    if conflict:
        raise ValueError(conflict)
    names = {f"c{i}": name for i, name in enumerate(left.columns)}
    uneven = _counted(left, right).where("nl != nr")
    near = [f"c{i}" for i, f in enumerate(left.schema) if types.is_float(f.dataType)]
    if atol is not None and near:
        uneven = _without_close(uneven, near, atol, rtol, group_limit)
    return uneven.select(
        F.when(F.col("nl") > F.col("nr"), "left").otherwise("right").alias("side"),
        _uneven().alias("n"),
        *[F.col(c).alias(name) for c, name in names.items()],
    )


def _without_close(
    uneven: DataFrame, near: list[str], atol: float, rtol: float, limit: int
) -> DataFrame:
    """What is left of a bag's uneven counts once close rows are set off against each other."""
    uneven = written(uneven, "uneven")
    columns = uneven.columns
    exact = [c for c in columns if c.startswith("c") and c not in near]
    sizes = uneven.groupBy(*exact).agg(F.count(F.lit(1)).alias("n"))
    blocked = (sizes.agg(F.max("n")).first()[0] or 0) > limit
    bag, marks = _clustered(uneven, exact, near, atol, rtol, blocked)
    keys = [*exact, *marks]
    over = F.col("nl") - F.col("nr")
    edges = [f(c).alias(f"{name}_{c}") for c in near for name, f in (("low", F.min), ("high", F.max))]
    sums = bag.groupBy(*keys).agg(F.sum(over).alias("more"), *edges)
    tight = F.lit(True)
    for c in near:
        tight = tight & close(F.col(f"low_{c}"), F.col(f"high_{c}"), atol, rtol)
    named = sums.select(*[F.col(k).alias(f"{k}__key") for k in keys], "more", tight.alias("tight"))
    bag = _in_blocks(bag, keys, near) if blocked else bag
    whole = bag.join(named, [F.col(k).eqNullSafe(F.col(f"{k}__key")) for k in keys])
    whole = whole.drop(*[f"{k}__key" for k in keys])
    # The side with more rows lists its first ones, until what it has more is reached.
    own = F.greatest(F.lit(0).cast("bigint"), over * F.signum("more").cast("bigint"))
    counted = running(whole.withColumn("own", own), keys, near, {"upto": ("sum", "own")}, "block" if blocked else None)
    open_ = F.abs(F.col("more")) - (F.col("upto") - F.col("own"))
    listed = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("own"), open_))
    zero = F.lit(0).cast("bigint")
    kept = counted.withColumn("listed", listed).withColumns(
        {
            "nl": F.when(~F.col("tight"), F.col("nl")).otherwise(F.when(F.col("more") > 0, F.col("listed")).otherwise(zero)),
            "nr": F.when(~F.col("tight"), F.col("nr")).otherwise(F.when(F.col("more") < 0, F.col("listed")).otherwise(zero)),
        }
    )
    return kept.where("nl != nr").select(*columns)


def diff_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Which column makes the difference: ``column``, ``left_value``, ``right_value``, ``n``, ``left``, ``right``.

    Of the rows without an equal partner, one of each side belong together if they agree in all columns
    but one and no other row agrees with them in these.  They are found by the hash of each row without
    one column, for every column in turn; hashes are counted by side, so nothing is paired off before it
    is known to be alone.  Rows that belong to none have a null ``column`` and a null ``left`` or ``right``.
    A row that goes with one row in one column and with another in another is listed with both.  Values are
    given as text, ``left`` and ``right`` are the rows under the left side's names, ``n`` how many copies the
    row has more than its partners (of a pair: of the left row).
    """
    names = left.columns
    rows = diff_rows(left, right)
    rows = rows.select("side", "n", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    rows = written(rows.withColumn("id", F.monotonically_increasing_id()), "uneven")
    cells = [F.coalesce(F.col(f"c{i}").cast("string"), F.lit("")) for i in range(len(names))]
    marks = [F.col(f"c{i}").isNull().cast("string") for i in range(len(names))]
    whole = F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])

    def without(i: int) -> Column:
        # Lengths keep neighbours apart, and NULL from an empty text.
        parts = [F.concat_ws(":", m, F.length(c), c) for j, (c, m) in enumerate(zip(cells, marks)) if j != i]
        return F.sha2(F.concat_ws(",", F.lit(i), *parts).cast("binary"), 256)

    value = [F.struct(F.lit(i).alias("at"), without(i).alias("rest"), F.col(f"c{i}").cast("string").alias("v")) for i in range(len(names))]
    each = rows.select("side", "id", "n", F.inline(F.array(*value)))
    sides = {}
    for side in ("left", "right"):
        own = F.col("side") == side
        sides |= {
            f"{side}_rows": F.count_if(own),
            f"{side}_id": F.max(F.when(own, F.col("id"))),
            f"{side}_value": F.max(F.when(own, F.col("v"))),
        }
    more = F.max(F.when(F.col("side") == "left", F.col("n")))
    met = each.groupBy("at", "rest").agg(*[c.alias(k) for k, c in sides.items()], more.alias("n"))
    pairs = written(met.where("left_rows = 1 AND right_rows = 1"), "pairs")
    listed = F.array(*[F.lit(c) for c in names])
    shown = rows.select("id", whole.alias("row"))
    found = (
        pairs.join(shown.withColumnsRenamed({"id": "left_id", "row": "left"}), "left_id")
        .join(shown.withColumnsRenamed({"id": "right_id", "row": "right"}), "right_id")
        .select(listed[F.col("at")].alias("column"), "left_value", "right_value", "n", "left", "right")
    )
    used = pairs.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct()
    alone = rows.join(used, "id", "left_anti").select(
        F.lit(None).cast("string").alias("column"),
        F.lit(None).cast("string").alias("left_value"),
        F.lit(None).cast("string").alias("right_value"),
        "n",
        F.when(F.col("side") == "left", whole).alias("left"),
        F.when(F.col("side") == "right", whole).alias("right"),
    )
    return found.unionByName(alone)
