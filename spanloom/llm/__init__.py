"""Operators for preparing training corpora, each a set of Spark jobs over plain DataFrames.

Nothing outside this subpackage imports it; the folder can be removed without touching the rest.
"""
