"""Training-data operators: scoring, sharding, deduplication, packing and encoding.

Nothing outside this folder imports it.
"""
