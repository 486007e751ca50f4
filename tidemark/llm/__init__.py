"""Operators that prepare text for language-model training.

Nothing outside this package imports it. ``queries`` holds the registered queries, ``oracle`` their SQL.
"""
