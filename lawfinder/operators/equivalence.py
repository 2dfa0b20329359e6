"""Which formulas of a table are the same function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tree
from ..sources.scratch import cut
from .once import beside, spread

#: Points that make the fingerprint, and fresh points of the check.
MADE, CHECKED = range(3), range(50, 56)
#: Cells of a fingerprint per unit of the logarithm.
CELLS = 1e9
#: What is left of values near 1 that cancel.
NIL = 1e-12


def _cells(t: Column) -> Column:
    """Two cells, of grids half a cell apart, in which a tree's value lies; null where it has none.

    Values of equal functions differ by rounding only, so that they share a
    cell of one of the grids at least.
    """
    def placed(v: Column) -> Column:
        at = F.ln(F.abs(v)) * CELLS
        side = F.signum(v).cast("int")
        return F.when(F.abs(v) < NIL, F.array(F.struct(F.lit(0), F.lit(0).cast("long")), F.struct(F.lit(0), F.lit(0).cast("long")))).otherwise(
            F.array(F.struct(side, F.floor(at)), F.struct(side, F.floor(at + 0.5)))
        )

    # The first point at which there is a value.
    values = F.array(*[tree.value(t, lambda n, s=s: tree.point(n, s)) for s in MADE])
    finite = F.filter(F.transform(values, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda p: ~F.isnan(p["v"]) & (F.abs(p["v"]) < F.lit(float("inf"))))
    return tree.let(finite, lambda ps: F.when(F.size(ps) > 0, F.transform(placed(ps[0]["v"]), lambda c: F.struct(ps[0]["i"].alias("i"), c.alias("cell")))))


def equivalent(df: DataFrame, formula: str, key: str) -> DataFrame:
    """``df`` with ``class_key``: the least ``key`` among rows whose formulas are the same function; null for what is no formula.

    Formulas of one tree are taken once. The others meet by fingerprint, in
    two grids; each is checked at fresh points against the least of its cell,
    so no cell is compared all with all. Functions that share a cell by
    chance (one pair in 1e9) and are not equal to its least stay alone there.
    Trees and cells are worked out once, spread over tasks, and written down.
    """
    texts = df.groupBy(F.col(f"`{formula}`").alias("__text")).agg(F.min(key).alias("__least"))
    known = cut(spread(texts, "__text").withColumn("__tree", tree.parsed(F.col("__text"))))
    trees = known.where(F.col("__tree").isNotNull()).groupBy("__tree").agg(F.min("__least").alias("__least"))
    cells = cut(spread(trees, "__tree").withColumn("__cells", _cells(F.col("__tree"))))
    met = cells
    for grid in (0, 1):
        at = F.col("__cells")[grid]
        first = cells.where(at.isNotNull()).groupBy(at.alias("__at")).agg(F.min_by(F.struct("__tree", "__least"), F.col("__least")).alias(f"__first{grid}"))
        met = met.withColumn("__at", at).join(first, "__at", "left").drop("__at")
    alike = lambda grid: F.coalesce(tree.equal_at(F.col("__tree"), F.col(f"__first{grid}.__tree"), CHECKED), F.lit(False))
    own, one, two = F.col("__least"), F.col("__first0.__least"), F.col("__first1.__least")
    # What is its cell's least, or has no cell, needs no check, and the same least in both grids only one.
    in_one = F.when(one.isNull() | (one == own), own).when(alike(0), one).otherwise(own)
    classed = spread(met, "__tree").withColumn("__c0", in_one)
    in_two = F.when(two.isNull() | (two == own), own).when(two == one, F.col("__c0")).when(alike(1), two).otherwise(own)
    classes = cut(classed.select("__tree", F.least(F.col("__c0"), in_two).alias("class_key")))
    by_text = known.join(classes, "__tree", "left").select("__text", "class_key")
    return beside(df, cut(by_text).withColumnRenamed("__text", formula), [formula])
