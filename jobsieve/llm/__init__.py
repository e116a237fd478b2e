"""Operators of a training-data pipeline: cleaning, de-duplication, scoring, tokens and shards."""
