"""Training-data operators: deduplication, filtering, packing, search and scoring at corpus scale.

Nothing outside this subpackage imports it.
"""
