"""Operators of a training-data pipeline: tokenizing, scoring, deduplication, packing, media."""
