"""Exact pairing of two bags of rows that may differ in several floating-point columns.

Two rows are partners if their exact columns are equal and every other column is close.  Whether all
rows can be paired off is a question of matching: a greedy choice or an order along one column can
miss the only pairing there is.

*Grid.*  A value's place is its distance from zero in tolerances: linear near zero, where the absolute
tolerance is the wider one, logarithmic beyond.  Close values are at most one place apart, so partners
lie in the same or neighbouring cells, and whether a row has candidates is a join on cells.

*Components.*  Linked cells form components; no pair spans two.  A component whose sides differ in
number has no pairing; one that is as a whole within tolerance has one.

*Matching.*  A component of at most ``limit`` rows is solved in one task, by Hopcroft and Karp's rounds
of shortest augmenting paths with counts for copies.  Larger ones are settled by ranks where those
suffice: a pairing of equal ranks is one, and a column whose own ranks are not close rules any out.  What
is still open is matched on a table of edges: each round grows a forest from the rows with something
left to pair and augments along one shortest path of every tree.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equivcheck.operators.components import components
from equivcheck.session import written

LIMIT = 2_000  # rows of a component that one task holds, and columns of the grid
COLUMNS = 4

Close = Callable[[Column, Column], Column]


def cell(value: Column, atol: float, rtol: float) -> Column:
    """The place of a value in the grid; NULL, NaN and infinities have places of their own."""
    small = max(atol, 1e-300)
    size = F.abs(value)
    near = size / F.lit(small)
    if rtol > 0:
        turn = small / rtol  # from here on the relative tolerance is the wider one
        far = (1.0 + F.log(size / F.lit(turn))) / F.lit(rtol)
        near = F.when(size <= F.lit(turn), near).otherwise(far)
    return F.rint(F.signum(value) * near / F.lit(1.001))


def _same(a: DataFrame, b: DataFrame, names: list[str], other: list[str]) -> Column:
    equal = [a[x].eqNullSafe(b[y]) for x, y in zip(names, other, strict=True)]
    return reduce(lambda p, q: p & q, equal, F.lit(True))


def _even(df: DataFrame, keys: list[str]) -> bool:
    sums = df.groupBy(*keys).agg(F.sum("nl").alias("nl"), F.sum("nr").alias("nr"))
    return sums.where("nl != nr").isEmpty()


def _ordered(cells: DataFrame, grid: list[str]) -> list[str]:
    """The columns of the grid that tell most cells apart; the others are compared afterwards."""
    if len(grid) <= COLUMNS:
        return grid
    counts = cells.agg(*[F.approx_count_distinct(g).alias(g) for g in grid]).first()
    return sorted(grid, key=lambda g: -counts[g])


def linked(bag: DataFrame, exact: list[str], near: list[str], atol: float, rtol: float) -> DataFrame:
    """``bag`` with ``comp``, the component of each row's cell, and ``node``, the cell."""
    grid = [f"g{i}" for i in range(len(near))]
    placed = bag.withColumns({g: cell(F.col(c), atol, rtol) for g, c in zip(grid, near, strict=True)})
    cells = placed.select(*exact, *grid).distinct().withColumn("node", F.monotonically_increasing_id())
    cells = written(cells, "cells")
    order = _ordered(cells, grid)
    joined, rest = order[:COLUMNS], order[COLUMNS:]
    # Half of the neighbours, each pair of cells being met from one side; the cell itself where
    # further columns may differ.
    steps = [s for s in product((-1, 0, 1), repeat=len(joined)) if s > (0,) * len(joined) or (rest and not any(s))]
    step = F.explode(F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])).alias("step")
    moved = cells.select("*", step)
    moved = moved.select(
        F.col("node").alias("a"),
        *[F.col(c).alias(f"{c}__a") for c in exact],
        *[(F.col(g) + F.col("step")[i]).alias(f"{g}__a") for i, g in enumerate(joined)],
        *[F.col(g).alias(f"{g}__a") for g in rest],
    )
    keys = [*exact, *joined]
    links = moved.join(cells, _same(moved, cells, [f"{k}__a" for k in keys], keys))
    for g in rest:
        # NULL next to NULL, NaN next to NaN: the difference of two such is neither.
        links = links.where(F.col(f"{g}__a").eqNullSafe(F.col(g)) | (F.abs(F.col(f"{g}__a") - F.col(g)) <= 1))
    named = components(cells.select("node"), links.select("a", F.col("node").alias("b")))
    named = cells.join(named, "node").select(
        *[F.col(c).alias(f"{c}__a") for c in [*exact, *grid]], "node", F.col("label").alias("comp")
    )
    found = placed.join(named, _same(placed, named, [*exact, *grid], [f"{c}__a" for c in [*exact, *grid]]))
    return written(found.select(*bag.columns, *grid, "node", "comp"), "linked")


def open_components(rows: DataFrame, near: list[str], close: Close) -> DataFrame:
    """``(comp, n)`` of the components that are not as a whole within tolerance, with their rows."""
    edges = [f(c).alias(f"{name}_{c}") for c in near for name, f in (("low", F.min), ("high", F.max))]
    sums = rows.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), *edges)
    tight = reduce(lambda a, b: a & b, [close(F.col(f"low_{c}"), F.col(f"high_{c}")) for c in near])
    return sums.where(~tight).select("comp", "n")


# -- one task ---------------------------------------------------------------------


def _is_close(a: float | None, b: float | None, atol: float, rtol: float) -> bool:
    if a is None or b is None:
        return a is b
    if a == b or (a != a and b != b):
        return True
    gap = abs(a - b)
    if gap != gap or gap == float("inf"):
        return False
    return gap < atol or gap <= rtol * max(abs(a), abs(b))


def perfect(left: list[tuple], right: list[tuple], atol: float, rtol: float) -> bool:
    """Whether rows ``(count, values)`` of both sides can be paired off, copies counted."""
    if sum(n for n, _ in left) != sum(n for n, _ in right):
        return False
    edges = [
        [j for j, (_, b) in enumerate(right) if all(_is_close(x, y, atol, rtol) for x, y in zip(a, b, strict=True))]
        for _, a in left
    ]
    spare_left, spare_right = [n for n, _ in left], [n for n, _ in right]
    flow: list[dict[int, int]] = [defaultdict(int) for _ in right]  # right -> left -> pairs
    while True:
        # Layers of left rows that alternating paths from rows with something to spare reach.
        depth = {i: 0 for i, n in enumerate(spare_left) if n}
        queue, ends = deque(depth), False
        while queue:
            i = queue.popleft()
            for j in edges[i]:
                ends = ends or spare_right[j] > 0
                for k, n in flow[j].items():
                    if n and k not in depth:
                        depth[k] = depth[i] + 1
                        queue.append(k)
        if not ends:
            return not any(spare_left)
        at = [0] * len(left)
        for root in [i for i, n in enumerate(spare_left) if n]:
            while spare_left[root] and (path := _path(root, depth, edges, flow, spare_right, at)):
                amount = min(spare_left[root], spare_right[path[-1][1]], *(n for _, _, n in path[:-1]))
                spare_left[root] -= amount
                spare_right[path[-1][1]] -= amount
                for (i, j, _), after in zip(path, [*path[1:], None], strict=True):
                    flow[j][i] += amount
                    if after:
                        flow[j][after[0]] -= amount


def _path(root, depth, edges, flow, spare_right, at) -> list[tuple[int, int, int]] | None:
    """A path of (left, right, pairs that can be undone) from a root along the layers, without recursion."""
    path: list[tuple[int, int, int]] = []
    i = root
    while True:
        step = None
        while at[i] < len(edges[i]):
            j = edges[i][at[i]]
            if spare_right[j] > 0:
                return [*path, (i, j, 0)]
            step = next(((k, n) for k, n in flow[j].items() if n and depth.get(k) == depth[i] + 1 and at[k] < len(edges[k])), None)
            if step:
                break
            at[i] += 1
        if step:
            path.append((i, j, step[1]))
            i = step[0]
        elif path:
            i = path.pop()[0]  # the row that led nowhere is spent, others may lead on from here
        else:
            return None


def _unmatched(rows: DataFrame, near: list[str], atol: float, rtol: float) -> DataFrame:
    """``(comp)`` of the components without a pairing; rows are gathered by component."""
    wanted = F.struct("nl", "nr", F.array(*[F.col(c).cast("double") for c in near]).alias("v"))
    held = rows.groupBy("comp").agg(F.collect_list(wanted).alias("held"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for comp, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sides = [[(m[n], m["v"]) for m in members if m[n]] for n in ("nl", "nr")]
                if not perfect(*sides, atol, rtol):
                    bad.append(comp)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int64())], ["comp"])

    return held.mapInArrow(solve, "comp long")


# -- many tasks -------------------------------------------------------------------


def edges(rows: DataFrame, near: list[str], close: Close) -> tuple[DataFrame, DataFrame]:
    """Rows with ``row``, a number of their own, and ``(l, r)`` for close rows of both sides."""
    grid = [c for c in rows.columns if c.startswith("g") and c[1:].isdigit()]
    numbered = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    joined = _ordered(numbered, grid)[:COLUMNS]
    step = F.explode(F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in product((-1, 0, 1), repeat=len(joined))]))
    left = numbered.where("nl > 0").select("*", step.alias("step"))
    left = left.select(
        F.col("row").alias("l"),
        F.col("comp").alias("comp__a"),
        *[F.col(c).alias(f"{c}__a") for c in near],
        *[(F.col(g) + F.col("step")[i]).alias(f"{g}__a") for i, g in enumerate(joined)],
    )
    right = numbered.where("nr > 0")
    keys = ["comp", *joined]
    pairs = left.join(right, _same(left, right, [f"{k}__a" for k in keys], keys))
    for c in near:
        pairs = pairs.where(close(F.col(f"{c}__a"), F.col(c)))
    return numbered, written(pairs.select("l", F.col("row").alias("r")).distinct(), "edges")


def matched(rows: DataFrame, pairs: DataFrame) -> bool:
    """Whether all of ``rows (row, nl, nr)`` can be paired along ``pairs (l, r)``."""
    left = rows.where("nl > 0").select(F.col("row").alias("l"), F.col("nl").alias("cap"))
    right = rows.where("nr > 0").select(F.col("row").alias("r"), F.col("nr").alias("cap"))
    flow = written(pairs.withColumn("f", F.lit(0).cast("bigint")).where("false"), "flow")
    while True:
        used_l = flow.groupBy("l").agg(F.sum("f").alias("used"))
        used_r = flow.groupBy("r").agg(F.sum("f").alias("used"))
        spare_l = written(_spare(left, used_l, "l"), "spare")
        spare_r = written(_spare(right, used_r, "r"), "spare")
        if spare_l.isEmpty():
            return True
        forest = _forest(pairs, flow, spare_l, spare_r)
        if forest is None:
            return False
        flow = _augmented(flow, spare_l, spare_r, *forest)


def _spare(side: DataFrame, used: DataFrame, key: str) -> DataFrame:
    left = F.col("cap") - F.coalesce("used", F.lit(0))
    return side.join(used, key, "left").select(key, left.alias("spare")).where("spare > 0")


def _forest(pairs: DataFrame, flow: DataFrame, spare_l: DataFrame, spare_r: DataFrame):
    """Layers of a forest of shortest alternating paths, until one reaches a row to spare.

    Each row is in one tree only, so paths of different roots share no row.
    """
    front = spare_l.select("l", F.col("l").alias("root"))
    seen_l, seen_r = front.select("l"), None
    ups, downs = [], []  # right rows with their parents, left rows with theirs
    while True:
        reached = front.join(pairs, "l")
        if seen_r is not None:
            reached = reached.join(seen_r, "r", "left_anti")
        best = F.min(F.struct("root", "l")).alias("by")
        layer = written(reached.groupBy("r").agg(best).select("r", "by.root", "by.l"), "layer")
        ups.append(layer)
        if layer.isEmpty():
            return None
        ends = layer.join(spare_r, "r").groupBy("root").agg(F.min("r").alias("r"))
        ends = written(ends, "ends")
        if not ends.isEmpty():
            return ups, downs, ends
        seen_r = layer.select("r") if seen_r is None else seen_r.unionByName(layer.select("r"))
        back = flow.where("f > 0").join(layer.select("r", "root"), "r").join(seen_l, "l", "left_anti")
        best = F.min(F.struct("root", "r")).alias("by")
        front = written(back.groupBy("l").agg(best).select("l", "by.root", "by.r"), "layer")
        downs.append(front)
        seen_l = seen_l.unionByName(front.select("l"))
        if front.isEmpty():
            return None
        front = front.select("l", "root")


def _augmented(flow, spare_l, spare_r, ups, downs, ends) -> DataFrame:
    """The flow after each tree's path has carried as much as it can."""
    steps, at = [], ends
    for depth in range(len(ups) - 1, -1, -1):
        up = at.join(ups[depth].select("r", "l"), "r").select("root", "l", "r")
        steps.append(up.withColumn("sign", F.lit(1)))
        if depth:
            at = up.select("root", "l").join(downs[depth - 1].select("l", "r"), "l").select("root", "l", "r")
            steps.append(at.withColumn("sign", F.lit(-1)))
            at = at.select("root", "r")
    path = written(reduce(DataFrame.unionByName, steps), "path")
    undone = path.where("sign < 0").join(flow, ["l", "r"]).groupBy("root").agg(F.min("f").alias("least"))
    amount = ends.join(spare_r, "r").select("root", F.col("spare").alias("end"))
    amount = amount.join(spare_l.select(F.col("l").alias("root"), "spare"), "root").join(undone, "root", "left")
    amount = amount.select("root", F.least("end", "spare", "least").alias("amount"))
    change = path.join(amount, "root").select("l", "r", (F.col("sign") * F.col("amount")).alias("f"))
    total = flow.unionByName(change).groupBy("l", "r").agg(F.sum("f").alias("f"))
    return written(total.where("f > 0"), "flow")


# -- all together -----------------------------------------------------------------


def paired(
    bag: DataFrame,
    exact: list[str],
    near: list[str],
    atol: float,
    rtol: float,
    close: Close,
    by_rank: Callable[[DataFrame, list[str], list[str]], bool],
    limit: int = LIMIT,
) -> bool:
    """Whether the two sides of ``bag`` (counts ``nl``, ``nr``) can be paired off within tolerance.

    ``by_rank(rows, groups, order)`` says whether rows of equal rank along ``order`` are close.
    """
    if not _even(bag, exact):
        return False
    rows = linked(bag, exact, near, atol, rtol)
    if not _even(rows, ["comp"]):  # rows that nothing on the other side is close to
        return False
    left = written(open_components(rows, near, close), "open")
    small = rows.join(left.where(F.col("n") <= limit).select("comp"), "comp")
    if not _unmatched(small, near, atol, rtol).isEmpty():
        return False
    large = left.where(F.col("n") > limit)
    if large.isEmpty():
        return True
    rest = written(rows.join(large.select("comp"), "comp"), "large")
    for c in near:
        single = rest.groupBy("comp", c).agg(F.sum("nl").alias("nl"), F.sum("nr").alias("nr"))
        if not by_rank(single, ["comp"], [c]):
            return False
    for lead in range(len(near)):
        if by_rank(rest, ["comp"], near[lead:] + near[:lead]):
            return True
    return matched(*edges(rest, near, close))
