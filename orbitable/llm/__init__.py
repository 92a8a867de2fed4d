"""Operators for training-data pipelines: deduplication, language, quality, tokens, packing.

Nothing outside this folder imports it; its registered queries live in `orbitable.llm.queries`.
"""
