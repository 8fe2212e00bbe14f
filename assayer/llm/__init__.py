"""Training-data operators: token counting, quality, dedup, packing and the rest.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
