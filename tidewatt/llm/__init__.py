"""Operators for preparing training corpora at scale.

Nothing else in the package imports this subpackage.  Every operator takes a
DataFrame and column names, selects only those columns, and works on whole
texts; the thin queries over the test tables are in ``queries``.
"""
