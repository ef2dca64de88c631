"""Operators of a training-data pipeline: sharding, mixing, secrets, toxicity, token files, chat, near-duplicates, leaks, quality, search."""
