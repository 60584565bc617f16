"""Operators of a training-data pipeline over `documents`, `embeddings` and `labels`.

Nothing else in the library imports this subpackage.
"""
