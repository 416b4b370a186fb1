"""Training-data operators: deduplication, extraction, search, tokenisation, archives, filtering and mixing.

Nothing outside this subpackage imports it.  Queries are collected in ``registry``.
"""
