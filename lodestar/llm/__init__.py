"""Operators for preparing training corpora: deduplication, filtering, scanning, sharding, mixing and encoding.

Nothing else in the library imports this subpackage; it can be removed without touching the rest.
"""
