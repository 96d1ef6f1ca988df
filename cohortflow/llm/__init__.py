"""Operators of a training-data pipeline (texts, web pages, mixtures).

Nothing outside this subpackage imports it.  Each operator module holds a
general DataFrame operator and the registered query that applies it to the
whole table; ``registry`` lists the queries.
"""
