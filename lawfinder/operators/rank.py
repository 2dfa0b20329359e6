"""Ranking of grammars and of candidate equations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.transforms import finite

# Weights of the research score, lower is better.
LOSS, COMPAT, COMPLEXITY = 0.60, 0.20, 0.20
NEAR = 0.02


def _unit(name: str, by: list[str]) -> Column:
    """A value between the least and greatest finite ones of its group as 0 to 1; 1 where that cannot be said."""
    w = Window.partitionBy(*by)
    v = F.when(finite(F.col(name)), F.col(name))
    low, high = F.min(v).over(w), F.max(v).over(w)
    return F.when(v.isNull() | (high - low <= 1e-12), 1.0).otherwise((v - low) / F.when(high - low > 1e-12, high - low))


def research_scores(probes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Combined score of each grammar's probe (cluster_id, loss, compatibility, complexity), with the winner and near ties.

    A group has one row per grammar.
    """
    by = by or []
    scaled = probes.withColumn("loss_part", _unit("loss", by)).withColumn("complexity_part", _unit("complexity", by))
    scored = scaled.withColumn("combined", LOSS * F.col("loss_part") + COMPAT * (1 - F.col("compatibility")) + COMPLEXITY * F.col("complexity_part"))
    order = Window.partitionBy(*by).orderBy("combined", "cluster_id")
    best = F.min("combined").over(Window.partitionBy(*by))
    return scored.withColumn("place", F.row_number().over(order)).withColumn("near_tie", F.col("combined") <= best + NEAR)


RANK = ("loss", "compatibility", "similarity", "complexity")


def _rank_order() -> list[Column]:
    return [F.asc("loss"), F.desc("compatibility"), F.desc("similarity"), F.asc("complexity")]


def merged(candidates: DataFrame, top: int = 10, tie: str = "cluster_id") -> DataFrame:
    """The best candidate of each structural key, ranked, with how many of the best each grammar gave."""
    own = F.row_number().over(Window.partitionBy("key").orderBy(*_rank_order(), tie))
    unique = candidates.withColumn("__n", own).where("__n = 1").drop("__n")
    first = unique.orderBy(*_rank_order(), tie, "key").limit(top)
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*_rank_order(), tie, "key")))
    return ranked.withColumn("contributed", F.count(F.lit(1)).over(Window.partitionBy("cluster_id")))


def best_runs(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Runs of each group in order of rounded R², compatibility, complexity and loss; missing ones count as worst."""
    inf = F.lit(float("inf"))
    order = [
        F.desc(F.bround(F.coalesce("r2", -inf), 5)), F.desc(F.coalesce("compatibility", F.lit(0.0))),
        F.asc(F.coalesce("complexity", inf)), F.asc(F.coalesce("loss", inf)), F.asc("cluster_id"),
    ]
    return runs.withColumn("place", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)))
