"""Operators of a training-data pipeline: de-duplication, search, filters, mixing, sharding and tokenising."""
