"""Operators for training-data pipelines, and the queries that apply them.

Nothing outside this package (and ``corpus_pipeline.py``) imports it; the entry point adds
its queries only where it is present. Each module is one operator with its own general
interface; ``queries`` derives the contract columns from it.
"""
