"""Operators of a training-data pipeline: filtering, deduplication, extraction and encoding of large text tables."""
