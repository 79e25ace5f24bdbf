"""Corpus operators for building language-model training data.

Nothing outside this package imports it.  Each module holds one operator with a
general interface; ``queries`` holds the registered queries and their SQL.
"""
