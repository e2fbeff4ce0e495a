"""Training-data operators: sharding, packing, tokenising, fingerprints, quality, near-duplicates, scoring, WARC.

Nothing else in the package imports this subpackage; it can be deleted as a whole.
"""
