"""Engineered features: roots, logarithms and pairwise quotients."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dataset import DatasetError, features_of, long_form
from .stats import FLAT, r2

RELEVANCE = 0.05


@dataclass(frozen=True)
class Feature:
    """A column to derive: its name, formula, kind, and the raw columns it uses."""

    name: str
    formula: str
    kind: str
    inputs: tuple[str, ...]

    def column(self) -> Column:
        a = F.col(f"`{self.inputs[0]}`")
        if self.kind == "raw":
            return a
        if self.kind == "inv_sqrt":
            return 1 / F.sqrt(a)
        if self.kind == "sqrt":
            return F.sqrt(a)
        if self.kind == "log":
            return F.ln(a)
        return a / F.sqrt(F.col(f"`{self.inputs[1]}`"))


def planned(names: list[str], positive: set[str], roots: bool = True, logs: bool = True) -> list[Feature]:
    """Features in order: for each column itself and what its sign allows, then quotients of ordered pairs."""
    plan = []
    for c in names:
        plan.append(Feature(c, c, "raw", (c,)))
        if c in positive and roots:
            plan += [Feature(f"inv_sqrt_{c}", f"1/sqrt({c})", "inv_sqrt", (c,)), Feature(f"sqrt_{c}", f"sqrt({c})", "sqrt", (c,))]
        if c in positive and logs:
            plan.append(Feature(f"log_{c}", f"log({c})", "log", (c,)))
    plan += [Feature(f"{a}_x_inv_sqrt_{b}", f"{a}/sqrt({b})", "quotient", (a, b)) for a in names for b in names if roots and a != b and b in positive]
    seen = [f.name for f in plan]
    if len(set(seen)) < len(seen):
        raise DatasetError(f"derived and raw columns share a name: {sorted({n for n in seen if seen.count(n) > 1})}")
    return plan


def positive_columns(df: DataFrame, names: list[str]) -> set[str]:
    """Columns whose every value is above 0; one aggregate pass."""
    low = df.agg(*[F.min(F.col(f"`{c}`")).alias(c) for c in names]).first()
    return {c for c in names if low[c] is not None and low[c] > 0}


def allowed(functions: set[str] | None) -> tuple[bool, bool]:
    """Whether roots and logarithms may be derived; no list allows all."""
    return (True, True) if functions is None else ("sqrt" in functions, bool({"log", "log10"} & functions))


def engineered(df: DataFrame, target: str, functions: set[str] | None = None) -> tuple[DataFrame, list[Feature]]:
    """The target with all planned features."""
    names = features_of(df, target)
    plan = planned(names, positive_columns(df, names), *allowed(functions))
    return df.select(F.col(f"`{target}`"), *[f.column().alias(f.name) for f in plan]), plan


def feature_scores(wide: DataFrame, target: str) -> DataFrame:
    """Per feature its population deviation and R²; one pass in long form."""
    rows = long_form(wide.withColumnRenamed(target, "__y"), ["__y"])
    return rows.groupBy("feature").agg(F.stddev_pop("x").alias("deviation"), r2(F.col("x"), F.col("__y")).alias("r2"))


def kept(scores: DataFrame, plan: list[Feature], threshold: float = RELEVANCE) -> DataFrame:
    """Scores of the features that stay: raw ones always, others if not near constant and relevant."""
    raw = F.col("feature").isin([f.name for f in plan if f.kind == "raw"])
    return scores.where(raw | ((F.col("deviation") >= FLAT) & (F.col("r2") >= threshold)))


def selected(df: DataFrame, target: str, functions: set[str] | None = None, threshold: float = RELEVANCE) -> tuple[DataFrame, list[Feature]]:
    """The engineered table narrowed to the features that stay; only feature names pass the driver."""
    wide, plan = engineered(df, target, functions)
    names = {r["feature"] for r in kept(feature_scores(wide, target), plan, threshold).select("feature").collect()}
    stay = [f for f in plan if f.name in names]
    return wide.select(F.col(f"`{target}`"), *[F.col(f"`{f.name}`") for f in stay]), stay
