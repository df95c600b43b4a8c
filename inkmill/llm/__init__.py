"""Training-data operators: scanning, filtering, deduplication, mixing and encoding of document tables.

Nothing outside this subpackage imports it.
"""
