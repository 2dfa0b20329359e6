"""Guarded transforms of a numeric column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def transform(op: str, x: Column) -> Column:
    """A probe transform; domains are bent so that any finite input has a value."""
    return {
        "raw": lambda: x,
        "log": lambda: F.ln(F.abs(x) + 1e-9),
        "log10": lambda: F.log10(F.abs(x) + 1e-9),
        "exp": lambda: F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x))),
        "sqrt": lambda: F.sqrt(F.abs(x)),
        "sin": lambda: F.sin(x), "cos": lambda: F.cos(x), "tan": lambda: F.tan(x),
        "sinh": lambda: F.sinh(x), "cosh": lambda: F.cosh(x), "tanh": lambda: F.tanh(x),
    }[op]()


TRANSFORMS = ("raw", "log", "log10", "exp", "sqrt", "sin", "cos", "tan", "sinh", "cosh", "tanh")


def finite(x: Column) -> Column:
    """Whether a value is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def confidence(percent: Column) -> Column:
    return F.when(percent.isNull(), "N/A").when(percent >= 80, "High").when(percent >= 50, "Medium").otherwise("Low")


def quality_label(quality: Column) -> Column:
    return F.when(quality >= 0.8, "clean").when(quality >= 0.4, "partial debris").otherwise("heavily garbled")


def adjusted_r2(r2: Column, rows: Column, predictors: Column) -> Column:
    free = rows - F.greatest(predictors, F.lit(0)) - 1
    return F.when(free > 0, 1 - (1 - r2) * (rows - 1) / F.when(free > 0, free))
