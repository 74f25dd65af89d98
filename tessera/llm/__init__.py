"""Training-data operators: similarity join, tokenising, scoring, fingerprints, search, mixing, sharding, scans, filters, chat.

Nothing outside this package imports it.
"""
