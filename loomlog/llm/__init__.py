"""Operators for language-model data: conversations, truncation, splitting, packing, mixing, languages."""
