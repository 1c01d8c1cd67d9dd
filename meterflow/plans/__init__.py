"""Whole requests built from the operators, and the queries on the given tables."""
