"""Operators of a training-data pipeline: scoring, deduplication, decontamination, search and packing.

Nothing outside this subpackage imports it.
"""
