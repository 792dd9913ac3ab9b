"""Operators that prepare mail and documents as training text. Nothing outside imports this package."""
