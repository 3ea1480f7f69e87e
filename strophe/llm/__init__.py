"""Operators for building training data for language models.

Nothing outside this folder imports it. Each module holds one operator with a
general interface; ``queries`` holds the registered ``opN_`` queries and their
SQL.
"""
