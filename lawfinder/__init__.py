"""Equation discovery and data preparation as Spark jobs."""
