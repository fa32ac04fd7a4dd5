"""Training-corpus operators: deduplication, extraction, packing, decontamination.

The rest of the library never imports this package.
"""
