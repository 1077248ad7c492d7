"""Operators of a training-data pipeline: quality, sharding, tokens, leaks, copies, toxicity, language, URLs."""
