"""Operators for preparing training text at scale.

Every module holds one operator with a general DataFrame interface;
``queries.py`` holds the thin registered queries and their DuckDB SQL.
Nothing outside this package imports it.
"""
