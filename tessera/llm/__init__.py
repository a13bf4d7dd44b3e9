"""Training-data operators: deduplication, archives, scanning, mixing, sharding.

Nothing else in the library imports this subpackage.
"""
