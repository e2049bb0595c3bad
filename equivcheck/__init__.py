"""Correctness checks for analytical queries without golden outputs.

A query and an independently rewritten form of it are both run on Spark and
their results are compared as bags of rows.  See README.md for the layout.
"""

from equivcheck.plans.compare import Verdict, compare, diff_rows
from equivcheck.plans.relations import RELATIONS, Params, origin, other

__all__ = ["RELATIONS", "Params", "Verdict", "compare", "diff_rows", "origin", "other"]
