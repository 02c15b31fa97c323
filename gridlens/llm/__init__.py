"""Operators of a training-data pipeline: filters, deduplication, packing, formatting and storage of corpora."""
