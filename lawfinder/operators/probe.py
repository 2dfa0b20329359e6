"""Scores of grammars: how well their functions, one at a time, explain the target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.transforms import TRANSFORMS, transform
from ..sources.dataset import long_form
from .stats import r2, transform_matrix

RAW_WEIGHT = 0.10
TIE = 1e-6
#: Nodes of ``a * x + b``; a function of x adds one.
LINE_NODES = 5


def grammar_scores(matrix: DataFrame, ops: DataFrame) -> DataFrame:
    """(cluster_id, score) from the R² of transforms and the grammars' function weights.

    The matrix does not depend on a grammar, so it is made once; what is
    joined has one row per transform and one per grammar operator.
    """
    best = matrix.groupBy("op").agg(F.max("r2").alias("best"))
    raw = best.where("op = 'raw'").select(F.lit(RAW_WEIGHT).alias("w"), F.col("best"))
    unary = ops.where("arity = 1 and weight > 0").select("cluster_id", "op", F.col("weight").alias("w"))
    terms = unary.join(best, "op").select("cluster_id", "w", "best")
    base = F.broadcast(raw)  # one row
    every = terms.unionByName(unary.select("cluster_id").distinct().join(base).select("cluster_id", "w", "best"))
    return every.groupBy("cluster_id").agg((F.sum(F.col("w") * F.col("best")) / F.sum("w")).alias("score"))


def winner(scores: DataFrame, grammars: DataFrame) -> DataFrame:
    """Scores with near ties of the best marked; the tied one with fewest equations wins."""
    best = F.max("score").over(Window.partitionBy())
    joined = scores.join(grammars.select("cluster_id", "equation_count"), "cluster_id")
    tied = joined.withColumn("tied", (best - F.col("score")) < TIE)
    order = Window.partitionBy().orderBy(F.desc("tied"), F.when(F.col("tied"), F.col("equation_count")), F.desc("score"), "cluster_id")
    return tied.withColumn("place", F.row_number().over(order)).withColumn("wins", F.col("place") == 1).drop("place")


def grouped_probes(df: DataFrame, target: str, by: list[str], ops: DataFrame) -> DataFrame:
    """For each group and grammar the best line in one function of one feature that the grammar allows.

    Returns the columns of ``by``, cluster_id, feature, op, r2, loss (mean
    squared error), complexity (nodes of the formula) and compatibility (the
    function's weight; ``RAW_WEIGHT`` for the feature as it is). Of equal R²
    to five places the simpler one wins, then the one the grammar favours.

    All groups, features and functions are scored in one pass, by sums that
    tasks make before the shuffle, so a group may hold any share of the rows.
    A null group is a group; rows without a target count for no R²; a group
    of under three rows has R² 0.
    """
    long = long_form(df.withColumnRenamed(target, "__y"), ["__y", *by]).withColumn("__y", F.col("__y").cast("double"))
    cells = F.array(*[F.struct(F.lit(op).alias("op"), transform(op, F.col("x")).alias("v")) for op in TRANSFORMS])
    spread = long.where("__y is not null").select(*by, "feature", "__y", F.inline(cells))
    fits = spread.groupBy(*by, "feature", "op").agg(r2(F.col("v"), F.col("__y")).alias("r2"), F.var_pop("__y").alias("__spread"))
    unary = ops.where("arity = 1 and weight > 0").select("cluster_id", "op", F.col("weight").alias("compatibility"))
    allowed = unary.unionByName(unary.select("cluster_id").distinct().select("cluster_id", F.lit("raw").alias("op"), F.lit(RAW_WEIGHT).alias("compatibility")))
    nodes = LINE_NODES + F.when(F.col("op") == "raw", 0.0).otherwise(1.0)
    scored = fits.join(allowed, "op").withColumn("complexity", nodes).withColumn("loss", (1 - F.col("r2")) * F.col("__spread"))
    order = Window.partitionBy(*by, "cluster_id").orderBy(F.desc(F.bround("r2", 5)), "complexity", F.desc("compatibility"), "feature", "op")
    best = scored.withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return best.select(*by, "cluster_id", "feature", "op", "r2", "loss", "complexity", "compatibility")


def fast_probe(df: DataFrame, target: str, grammars: DataFrame, ops: DataFrame) -> DataFrame:
    return winner(grammar_scores(transform_matrix(df, target), ops), grammars)
