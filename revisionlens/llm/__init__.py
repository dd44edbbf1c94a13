"""Operators of a training-data pipeline: deduplication, decontamination, mixing, extraction, filters and token output.

Nothing else in the library imports this subpackage.
"""
