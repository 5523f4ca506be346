"""Training-data operators: language ID, deduplication, fingerprints, classifiers, packing, scoring, sharding, mixing, search.

Nothing else in the library imports this subpackage.
"""
