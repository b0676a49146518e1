"""Operators of a training-data pipeline: decontamination, quality, search, deduplication, tokens, packing, chat.

Nothing outside this package imports it; its queries are collected in ``llm.queries``.
"""
