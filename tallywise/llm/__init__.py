"""Operators of a training-data pipeline: deduplication, extraction, tokens, sharding, language, quality, search."""
