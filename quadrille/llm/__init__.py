"""Training-data operators: search, quality, tokens, packing, dedup and scans.

Nothing outside this folder imports it; ``queries`` registers its queries.
"""
