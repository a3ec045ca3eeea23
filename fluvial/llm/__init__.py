"""Training-data operators: sharding, packing, search, dedup, tokens, classifiers, WARC.

Nothing else in the library imports this subpackage.
"""
