"""Corpus operators for training-data pipelines.

One module per operator.  ``queries`` registers them under their ``opN_`` names; nothing
outside this package imports it.
"""
