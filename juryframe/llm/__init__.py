"""Operators of a training-data pipeline: mixing, packing, counting, filtering, de-duplicating and archiving text."""
