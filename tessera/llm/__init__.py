"""Operators for training-data pipelines: tokens, quality, duplicates, personal data, search, manifests."""
