"""Operators of a training-data pipeline: token files, counts, packing, deduplication, filters."""
