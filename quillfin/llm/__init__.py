"""Training-data operators: tokenisation, archives, deduplication, classifiers.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
