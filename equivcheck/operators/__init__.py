"""Relational operators the relations are built from."""
