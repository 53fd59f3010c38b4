"""Operators for preparing and scoring training text; nothing else in the library imports this folder."""
