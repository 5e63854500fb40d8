"""Training-data operators: search, deduplication, scoring, tokenizing, packing, sharding and media.

Nothing outside this package imports it.
"""
