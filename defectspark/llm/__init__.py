"""Operators for preparing training text: sharding, privacy, quality, toxicity, scoring, overlap, packing."""
