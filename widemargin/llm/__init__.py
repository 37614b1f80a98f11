"""Operators of a training-data pipeline: dedup, filters, scans, mixing and search over text and vector tables."""
