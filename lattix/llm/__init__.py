"""Operators for building language-model training data on Spark.

Each operator lives in a module of its own; ``queries`` registers the thin
contract queries. Nothing outside this subpackage imports it.
"""
