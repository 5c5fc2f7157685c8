"""Operators for training-data pipelines: deduplication, packing, tokens, chat, language, quality."""
