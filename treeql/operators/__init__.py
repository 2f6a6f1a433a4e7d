"""Operators on `nodes`, spans and texts, as DataFrame transformations."""
