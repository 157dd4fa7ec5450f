"""Operators for training-data pipelines: quality, licences, chat, privacy, pages, mixing, tokens, duplicates."""
