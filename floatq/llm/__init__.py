"""Operators for preparing training text at scale.

Each module holds one operator with a general interface; ``queries`` holds the
thin queries and their SQL.  Nothing outside this package imports it.
"""
