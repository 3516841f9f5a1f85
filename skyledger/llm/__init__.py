"""Operators for training-data pipelines: packing, search, deduplication, mixing, sharding, toxicity, personal data."""
