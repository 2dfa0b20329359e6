"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import cut, drop_cut, scratch_folder, scratch_root  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def split_id(id_col: str = "doc_id") -> list[Column]:
    """An id as ``no_id`` and ``own_id``, never null: pandas makes doubles of whole numbers beside nulls, which changes large ones."""
    return [F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("own_id")]


def whole_id(name: str = "doc_id") -> Column:
    """The id that :func:`split_id` took apart."""
    return F.when(~F.col("no_id"), F.col("own_id")).alias(name)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def crc_mod(id_col: Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; fixes the folds of labelled rows."""
    return F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % F.lit(modulus)


def numbered(
    df: DataFrame, keys: list[str], order: list[Column], out: str, buckets: int = 64
) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in a fixed order.

    A key may hold any share of the rows. Rows are dealt to ``buckets`` hash
    buckets of the order columns, counted per (key, bucket), numbered inside
    each bucket, and shifted by the running total of the buckets before.
    """
    b, off = f"__{out}_bucket", f"__{out}_offset"
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n"))
    # One row per (key, bucket): without keys, ``buckets`` rows in one task.
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(off)
    )
    inside = Window.partitionBy(*keys, b).orderBy(*order)
    ranked = dealt.withColumn("__rank", F.row_number().over(inside) - 1)
    joined = ranked.join(
        offsets.select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.col(b).alias("__o_b"), off),
        on=[F.col(k).eqNullSafe(F.col(f"__o_{k}")) for k in keys] + [F.col(b) == F.col("__o_b")],
    )
    return joined.select(*df.columns, (F.col("__rank") + F.col(off)).cast("long").alias(out))


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components of an undirected graph, as (node, component).

    ``component`` is the smallest node id of the component. Each round every
    node takes the neighbour of lowest round-specific hash, the edges are
    rewritten to those representatives, and finished ones fall away, so the
    edge list shrinks by a constant factor a round whatever the shape of the
    graph. Hubs are met by partial aggregation and by joins between tables
    read from files, whose skewed partitions adaptive execution may split.
    """
    def tidy(a: Column, b: Column) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    pairs = cut(
        edges.where(F.col(src) != F.col(dst)).select(*tidy(F.col(src), F.col(dst))).distinct()
    )
    rounds: list[DataFrame] = []
    level = 0
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(level), c).alias("h"), c.alias("v"))  # noqa: B023, E731
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(rank(F.col("b"))).alias("near"))
        own = rank(F.col("node"))
        step = cut(best.select("node", F.least(own, F.col("near"))["v"].alias("rep")))
        rounds.append(step)
        left = step.select(F.col("node").alias("a"), F.col("rep").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("rep").alias("rb"))
        moved = pairs.join(left, "a").join(right, "b").where("ra != rb")
        old, pairs = pairs, cut(moved.select(*tidy(F.col("ra"), F.col("rb"))).distinct())
        drop_cut(old)
        level += 1
    if not rounds:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[-1]
    for step in reversed(rounds[:-1]):
        later = found.select(F.col("node").alias("rep"), F.col("rep").alias("__final"))
        found = cut(
            step.join(later, "rep", "left").select(
                "node", F.coalesce(F.col("__final"), F.col("rep")).alias("rep")
            )
        )
    least = found.groupBy("rep").agg(F.least(F.min("node"), F.col("rep")).alias("component"))
    return found.join(cut(least), "rep").select("node", "component")
