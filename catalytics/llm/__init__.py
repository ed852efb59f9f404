"""Training-data operators: language ID, dedup, secrets, search, packing, mixing, scoring, personal data.

Nothing else in the library imports this subpackage.
"""
