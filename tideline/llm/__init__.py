"""Training-data operators: search, dedup, quality, mixing, packing, privacy, licences.

Nothing outside this subpackage imports it.
"""
