"""Operators of a training-data pipeline: quality, mixing, extraction, search, dedup, licences, BPE, sharding, URLs.

Nothing else in the library imports this package.
"""
