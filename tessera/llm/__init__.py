"""Operators of a training-data pipeline: packing, token files, filters, archives, dedup, shards and media."""
