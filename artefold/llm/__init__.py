"""Operators for language-model training data; nothing else of the library imports this package."""
