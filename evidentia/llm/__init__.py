"""Training-data operators: mixing, deduplication, scoring, search, scans, packing and binary output.

Nothing else in the library imports this subpackage.
"""
