"""Training-data operators: extraction, deduplication, tokens, quality, packing.

Each module holds one operator with its general interface; ``queries`` binds
them to the tables of the benchmark.  Nothing outside this package imports it.
"""
