"""Probing of data that keeps arriving."""
