"""Operators for preparing training text: near-duplicates, language, repeated passages, tokens, scoring, archives."""
