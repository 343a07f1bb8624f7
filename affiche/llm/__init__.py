"""Operators for training-data pipelines: search, deduplication, packing, sharding, encoding, rules, licences."""
