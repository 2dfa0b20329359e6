"""Searching and describing a catalogue of named records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import matches_all

ALL = "All subfields"
SHOWN = 40


def searched(rows: DataFrame, query: str, fields: list[str], category: str | None = None, column: str = "subfield") -> DataFrame:
    """Rows of a category (or all) in whose joined fields every word of the query occurs."""
    hay = F.concat_ws(" ", *[F.coalesce(F.concat_ws(" ", F.col(f)), F.lit("")) for f in fields])
    kept = rows.where(matches_all(hay, query))
    return kept if not category or category.strip() in ("", ALL) else kept.where(F.col(column) == category.strip())


def labelled(rows: DataFrame, base: Column, order: list[str], name: str = "label", pieces: int = 64) -> DataFrame:
    """Display labels; the second and later of equal ones, in order, get a number.

    A label may stand on any share of the rows: the first column of the
    order, a number, is cut into ``pieces`` ranges of like many rows, rows are
    counted per label and range, numbered inside each, and shifted by the
    counts of the ranges before.
    """
    at = F.col(order[0]).cast("double")
    cuts = rows.agg(F.percentile_approx(at, [i / pieces for i in range(1, pieces)], 1000)).first()[0] or []
    bounds = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    dealt = rows.withColumn("__base", base).withColumn("__piece", F.size(F.filter(bounds, lambda c: c < at)))
    counts = dealt.groupBy("__base", "__piece").agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.partitionBy("__base").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("__base").alias("__of"), F.col("__piece").alias("__in"), F.coalesce(before, F.lit(0)).alias("__off"))
    inside = F.row_number().over(Window.partitionBy("__base", "__piece").orderBy(*order))
    numbered = dealt.withColumn("__r", inside).join(offsets, F.col("__base").eqNullSafe(F.col("__of")) & (F.col("__piece") == F.col("__in")))
    n = F.col("__r") + F.col("__off")
    shown = F.when(n == 1, F.col("__base")).otherwise(F.concat(F.col("__base"), F.lit(" #"), n.cast("string")))
    return numbered.withColumn(name, shown).drop("__base", "__piece", "__of", "__in", "__off", "__r")


def profile(rows: DataFrame, group: str, category: str, sample: str, order: str, top: int = 3) -> DataFrame:
    """Per group its size, its most frequent categories (ties by first seen) and its first samples.

    Counting goes before ranking, and samples are the least ``top`` by order
    within each task first, so a group may hold any share of the rows.
    """
    counts = rows.groupBy(group, category).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "first", category))
    best = counts.withColumn("place", place).where(F.col("place") <= top)
    lists = best.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", category))), lambda s: s[category]).alias("top_categories"))
    totals = counts.groupBy(group).agg(F.sum("n").alias("total"))
    early = rows.select(group, sample, order).withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("__r") <= top)
    firsts = early.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", sample))), lambda s: s[sample]).alias("samples"))
    return totals.join(lists, group).join(firsts, group)


def shown(rows: DataFrame, order: list[str], most: int = SHOWN) -> DataFrame:
    """The first rows for display."""
    return rows.orderBy(*order).limit(most)
