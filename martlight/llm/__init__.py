"""Operators of a training-data pipeline: tokens, shards, quality, duplicates, packing, pages, archives."""
