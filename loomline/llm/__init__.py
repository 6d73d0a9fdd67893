"""Operators of a training-data pipeline: archives, tokens, near-duplicates, scoring and filtering.

Nothing outside this subpackage imports it. Each module holds one operator with a general
interface; ``queries`` holds the thin queries over the given tables.
"""
