"""Scalar expressions and exact numeric aggregation."""
