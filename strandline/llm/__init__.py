"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
queries that ``__spark_entry__`` registers; every operator lives in its own
module with a general interface (any table, any column names).
"""
