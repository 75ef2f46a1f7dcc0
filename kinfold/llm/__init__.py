"""Operators for preparing training corpora; nothing else in kinfold imports this package."""
