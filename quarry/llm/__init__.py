"""Operators for preparing training text. Nothing else in quarry imports this package."""
