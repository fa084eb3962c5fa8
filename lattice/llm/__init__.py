"""Operators for training-data pipelines: text, tokens, vectors and urls.

Nothing outside this subpackage imports it.
"""
