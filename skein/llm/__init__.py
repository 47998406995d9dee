"""Operators for training-data corpora: thirteen Spark jobs over text tables.

Nothing outside this subpackage imports it.
"""
