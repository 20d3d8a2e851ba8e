"""Operators of a training-data pipeline: archives, dedup, filters, scoring, formatting and mixing."""
