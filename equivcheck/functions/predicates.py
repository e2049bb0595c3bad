"""Seeded random predicates over a schema, and a profile of how they split a table."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equivcheck import types
from equivcheck.functions import arith

# Chance that a branch ends early, and that its leaf is a column.
EARLY_LEAF = 0.25
COLUMN_LEAF = 0.50


@dataclass(frozen=True)
class Leaf:
    sql: str
    is_literal: bool
    is_bool: bool = False


@dataclass(frozen=True)
class Node:
    sql: str
    children: tuple


def acceptable(tree) -> bool:
    """No lone literal, no bool literal, and no operator over two literals."""
    if isinstance(tree, Leaf):
        return not tree.is_literal
    leaves = [c for c in tree.children if isinstance(c, Leaf)]
    if any(leaf.is_literal and leaf.is_bool for leaf in leaves):
        return False
    if len(tree.children) == 2 and len(leaves) == 2 and all(leaf.is_literal for leaf in leaves):
        return False
    return all(acceptable(c) for c in tree.children if isinstance(c, Node))


class ExpressionPool:
    """Draws expressions over the numeric (and bool) columns of a schema.

    ``literals`` maps a column to sample values of it (see ``quantiles``);
    without it literals span the whole type, floats lie in [0, 1).
    """

    def __init__(self, schema: T.StructType, seed: int, literals: dict[str, list] | None = None):
        self.rng = random.Random(seed)
        self.by_type: dict[T.DataType, list[str]] = {}
        for field in schema:
            if types.is_numeric(field.dataType):
                self.by_type.setdefault(field.dataType, []).append(field.name)
        self.flags = [f.name for f in schema if isinstance(f.dataType, T.BooleanType)]
        self.literals = literals or {}

    def predicate(self, depth: int = 3) -> str:
        return self.predicate_tree(depth).sql

    def predicate_tree(self, depth: int = 3):
        if not self.by_type:
            raise ValueError("no numeric column to build a predicate from")
        return self._bool(depth)

    def number(self, dtype: T.DataType, depth: int = 1) -> str:
        """A random arithmetic expression of type ``dtype`` over columns of that type."""
        return self._number(dtype, depth).sql

    def _bool(self, depth: int):
        ops = arith.RELATIONAL + (arith.LOGICAL if depth > 1 else [])
        if self.flags and (depth == 0 or self.rng.random() < EARLY_LEAF):
            return Leaf(arith.column(self.rng.choice(self.flags)), is_literal=False, is_bool=True)
        op = self.rng.choice(ops)
        if op in arith.LOGICAL:
            left, right = self._bool(depth - 1), self._bool(depth - 1)
            return Node(arith.logical(op, left.sql, right.sql), (left, right))
        dtype = self.rng.choice(list(self.by_type))
        left, right = self._operands(dtype, max(depth - 1, 0))
        return Node(arith.relational(op, left.sql, right.sql), (left, right))

    def _number(self, dtype: T.DataType, depth: int):
        if depth == 0 or self.rng.random() < EARLY_LEAF:
            return self._leaf(dtype)
        op = self.rng.choice(arith.ARITHMETIC)
        left, right = self._operands(dtype, depth - 1)
        return Node(arith.arithmetic(op, left.sql, right.sql, dtype), (left, right))

    def _operands(self, dtype: T.DataType, depth: int):
        """Two operands, at least one of which is not a literal."""
        pair = [self._number(dtype, depth), self._number(dtype, depth)]
        if all(isinstance(p, Leaf) and p.is_literal for p in pair):
            pair[self.rng.randrange(2)] = self._column(dtype)
        return pair

    def _leaf(self, dtype: T.DataType) -> Leaf:
        if self.by_type.get(dtype) and self.rng.random() < COLUMN_LEAF:
            return self._column(dtype)
        return Leaf(arith.literal(self._value(dtype), dtype), is_literal=True)

    def _column(self, dtype: T.DataType) -> Leaf:
        return Leaf(arith.column(self.rng.choice(self.by_type[dtype])), is_literal=False)

    def _value(self, dtype: T.DataType):
        known = [v for name in self.by_type.get(dtype, []) for v in self.literals.get(name, [])]
        if known:
            return self.rng.choice(known)
        if isinstance(dtype, T.DecimalType):
            return self.rng.randrange(10 ** (dtype.precision - dtype.scale))
        if types.is_float(dtype):
            return self.rng.random()
        bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}[dtype.simpleString()]
        return self.rng.randrange(-(2 ** (bits - 1)), 2 ** (bits - 1))


def quantiles(df: DataFrame, parts: int = 10) -> dict[str, list]:
    """Inner quantiles of every numeric column, in one pass: ``parts - 1`` values per column.

    Literals drawn from them split the data; literals drawn from the whole type
    mostly leave one side empty.
    """
    names = [f.name for f in df.schema if types.is_numeric(f.dataType)]
    at = [i / parts for i in range(1, parts)]
    row = df.agg(*[F.percentile_approx(n, at).alias(n) for n in names]).first()
    return {n: list(row[n] or []) for n in names}


def partition_profile(df: DataFrame, predicates: list[str]) -> DataFrame:
    """Rows where each predicate is true, false and NULL: one scan for all of them."""
    outcomes = {"n_true": "{}", "n_false": "NOT {}", "n_null": "{} IS NULL"}
    counts = df.agg(
        *[
            F.count_if(F.expr(form.format(f"({p})"))).alias(f"{name}{i}")
            for i, p in enumerate(predicates)
            for name, form in outcomes.items()
        ]
    )
    rows = [
        F.struct(
            F.lit(i).alias("predicate_id"),
            F.lit(p).alias("predicate"),
            *[F.col(f"{name}{i}").alias(name) for name in outcomes],
        )
        for i, p in enumerate(predicates)
    ]
    return counts.select(F.inline(F.array(*rows)))


ROUNDS, PROFILED = 60, 100


def splitting_predicates(
    df: DataFrame, seed: int, count: int, depth: int = 3, literals: dict[str, list] | None = None
) -> list[str]:
    """``count`` predicates that leave neither the true nor the false side empty.

    Literals are quantiles of the columns, taken here where not given.  All are different.  Twice
    as many candidates as are still wanted are profiled in one scan, until there are enough; a
    table that ``ROUNDS`` scans do not split often enough is an error.
    """
    pool = ExpressionPool(df.schema, seed, quantiles(df) if literals is None else literals)
    good: dict[str, None] = {}
    for _ in range(ROUNDS):
        # A scan profiles a bounded number: its plan has three counts for each.
        drawn = [pool.predicate(depth) for _ in range(min(PROFILED, 2 * (count - len(good)) + 6))]
        for row in partition_profile(df, list(dict.fromkeys(drawn))).orderBy("predicate_id").collect():
            if row.n_true and row.n_false and len(good) < count:
                good[row.predicate] = None
        if len(good) >= count:
            return list(good)
    raise ValueError(f"only {len(good)} of {count} predicates split the table")
