"""Operators that prepare training data: filtering, deduplication, tokenization, packing, sharding."""
