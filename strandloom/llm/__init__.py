"""Training-data operators: filtering, deduplication, mixing and packing of text.

Nothing outside this subpackage imports it.
"""
