"""Operators for training-data pipelines: scans, dedup, scoring, mixing, packing.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; :mod:`millrace.llm.queries` holds the
thin queries that apply them to the test tables.
"""
