"""Operators of a training-data pipeline over text tables.

Each module holds one operator with a general interface and the thin query that applies it to
the whole of its table; ``queries.py`` lists the queries and their SQL.
"""
