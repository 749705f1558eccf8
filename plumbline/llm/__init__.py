"""Training-data operators: quality, language, deduplication, search, mixing and packing.

Each module holds one operator with a general interface; ``queries`` binds them to the
shared tables. Nothing outside this package imports it.
"""
