"""Operators for training-data pipelines: deduplication, fingerprints, scoring, tokens, mixing."""
