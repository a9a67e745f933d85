"""Operators for large training-text collections (near-duplicates, leaks, packing, ...).

Nothing outside this subpackage imports it; it may be removed as a whole.
"""
