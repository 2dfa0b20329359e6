"""Readers of datasets, grammars and equation libraries."""
