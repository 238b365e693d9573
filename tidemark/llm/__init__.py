"""Operators for training-data pipelines: encoding, deduplication, filtering, sharding, packing."""
