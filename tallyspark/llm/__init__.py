"""Corpus operators for large-scale text preparation.

Nothing else in the library imports this subpackage; `queries` lists what it
adds to the query registry.
"""
