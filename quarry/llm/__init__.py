"""Operators for building large training corpora.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` holds the thin registered
queries that apply the operators to the shared tables.
"""
