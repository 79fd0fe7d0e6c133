"""Operators of a training-data pipeline: packing, archives, near duplicates, languages, secrets, scoring, formatting."""
