"""Training-data operators: sanitising, quality, decontamination, deduplication, archives, packing and extraction.

Nothing else in the library imports this subpackage.
"""
