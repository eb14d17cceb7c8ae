"""Training-data operators: selection, deduplication, packing, formatting and archives.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
