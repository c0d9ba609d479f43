"""Training-data operators: cleaning, deduplication, filtering and formatting of text tables.

Nothing outside this subpackage imports it; `queries.py` registers its queries.
"""
