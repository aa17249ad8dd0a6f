"""Operators for preparing language-model training data.

Nothing outside this package, its tests and ``corpus_pipeline.py`` imports it.
"""
