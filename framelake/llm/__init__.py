"""Training-data operators: tokenising, dedup, filtering, scanning and extraction over document tables.

Nothing else in the library imports this subpackage.
"""
