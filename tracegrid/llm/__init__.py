"""Operators of a training-data pipeline: percentile digests, packing, mixing and reading level."""
