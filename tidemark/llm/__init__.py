"""Training-data operators: dedup, filters, search, packing and binary output.

Nothing outside this subpackage imports it.
"""
