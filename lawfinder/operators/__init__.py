"""Relational operators over datasets, formulas and candidates."""
