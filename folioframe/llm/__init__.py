"""Operators for preparing text and vector corpora; nothing outside imports this package."""
