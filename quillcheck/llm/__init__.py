"""Operators for training-data pipelines: fingerprints, counting, deduplication, quality, mixing, language, tokens."""
