"""Operators of a training-data pipeline over a ``documents`` table.

Nothing else in the library imports this subpackage; its queries and SQL are
in ``queries.py``.
"""
