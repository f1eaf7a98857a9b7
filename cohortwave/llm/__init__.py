"""Operators for preparing training text at scale.

Each module holds one operator: DataFrames in, DataFrames out. ``queries`` binds them to the
given tables, ``words`` and ``tables`` hold what several of them share.
"""
