"""Operators of a training-data pipeline: scoring, archives, duplicates, filters, search, packing."""
