"""Operators for building training data at scale.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin queries over the driver's tables are in ``queries``.
"""
