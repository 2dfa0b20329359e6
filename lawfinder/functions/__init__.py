"""Column functions: guarded transforms and equation text."""
