"""Regression statistics, scaling and metrics, all as aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.transforms import TRANSFORMS, finite, transform
from ..sources.dataset import long_form

FLAT = 1e-10


def r2(x: Column, y: Column) -> Column:
    """Aggregate: R² of a line through (x, y), 0 for flat x, under three rows, or a value that is not finite."""
    ok = finite(x)
    inner = F.when(ok, x)
    flat = (F.stddev_pop(inner) < FLAT) | (F.count(F.lit(1)) < 3) | ~F.bool_and(ok)
    return F.when(flat, 0.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(F.regr_r2(y, inner), F.lit(0.0))))


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Long form (feature, x, y)."""
    return long_form(df.withColumnRenamed(target, "__y"), ["__y"]).select("feature", "x", F.col("__y").cast("double").alias("y"))


def univariate_r2(df: DataFrame, target: str) -> DataFrame:
    return with_target(df, target).groupBy("feature").agg(r2(F.col("x"), F.col("y")).alias("r2"))


def transform_matrix(df: DataFrame, target: str) -> DataFrame:
    """R² of every transform of every feature, from one pass over the data."""
    cells = F.array(*[F.struct(F.lit(op).alias("op"), transform(op, F.col("x")).alias("v")) for op in TRANSFORMS])
    spread = with_target(df, target).select("feature", "x", "y", F.inline(cells))
    return spread.groupBy("op", "feature").agg(r2(F.col("v"), F.col("y")).alias("r2"))


def top_features(scores: DataFrame, names: list[str], top: int = 10) -> DataFrame:
    """The features of highest R²; ties in column order."""
    at = F.array_position(F.array(*map(F.lit, names)), F.col("feature"))
    return scores.orderBy(F.desc("r2"), at).limit(top)


#: Rows of a bracket that one task ranks at most, where brackets can be narrowed to that.
RANKED = 100_000
_GRID = 200


def _narrowed(rows: DataFrame, spans: list[tuple], accuracy: int, most: int) -> list[tuple]:
    """Brackets (feature, share, low, high, at) of ranks, cut down by passes of their own until each holds at most ``most`` rows or one value."""
    spark = rows.sparkSession
    done: list[tuple] = []
    while spans:
        known = spark.createDataFrame(spans, "feature string, share double, low double, high double, at double")
        inside = F.when(F.col("x").between(F.col("low"), F.col("high")), F.col("x"))
        grid = [i / _GRID for i in range(_GRID + 1)]
        found = rows.join(F.broadcast(known), "feature").groupBy("feature", "share", "low", "high", "at").agg(  # a row per column and share
            F.count(F.when(F.col("x") < F.col("low"), 1)).alias("before"), F.count(inside).alias("inside"), F.percentile_approx(inside, grid, accuracy).alias("p")
        )
        spans = []
        for r in found.collect():
            share = (r["at"] - r["before"]) / max(1, r["inside"] - 1)
            low = r["p"][max(0, int((share - 3 / accuracy) * _GRID) - 1)]
            high = r["p"][min(_GRID, int((share + 3 / accuracy) * _GRID) + 2)]
            span = (r["feature"], r["share"], low, high, r["at"])
            # Narrower by value, so this ends; copies of a value cannot be cut apart and are one row of the ranking.
            small = r["inside"] <= most or r["low"] == r["high"] or (low, high) == (r["low"], r["high"])
            (done if small else spans).append((r["feature"], r["share"], r["low"], r["high"], r["at"]) if small else span)
    return done


def quantiles(df: DataFrame, shares: tuple[float, ...], accuracy: int = 10_000, most: int = RANKED) -> DataFrame:
    """Exact interpolated quantiles of each column, as (feature, share, value), in bounded memory.

    A sketch brackets the ranks wanted of each column; where a bracket, about
    ``6 / accuracy`` of the rows, may hold more than ``most`` rows, it is
    narrowed by further passes. The values inside are then counted and ranked
    in one task. Nulls are passed over.
    """
    rows = long_form(df).where("x is not null")
    near = [min(1.0, max(0.0, p + side * 3 / accuracy)) for p in shares for side in (-1, 1)]
    bounds = rows.groupBy("feature").agg(F.percentile_approx("x", near, accuracy).alias("b"), F.count(F.lit(1)).alias("n"))
    wanted = F.array(*[
        F.struct(F.lit(p).alias("share"), F.col("b")[2 * i].alias("low"), F.col("b")[2 * i + 1].alias("high"), (F.lit(p) * (F.col("n") - 1)).alias("at"))
        for i, p in enumerate(shares)
    ])
    # A row per column and share.
    spans = bounds.select("feature", F.inline(wanted), "n").collect()
    large = [tuple(r)[:5] for r in spans if 6 * r["n"] > most * accuracy]
    spans = [tuple(r)[:5] for r in spans if 6 * r["n"] <= most * accuracy] + _narrowed(rows, large, accuracy, most)
    spans = df.sparkSession.createDataFrame(spans, "feature string, share double, low double, high double, at double")
    own = ["feature", "share", "at"]
    # What lies outside a bracket is only counted, by side, with the value next to the bracket.
    side = F.when(F.col("x") < F.col("low"), -1).when(F.col("x") > F.col("high"), 1).otherwise(0)
    placed = rows.join(F.broadcast(spans), "feature").withColumn("side", side)
    inside = F.when(F.col("side") == 0, F.col("x"))
    counted = placed.groupBy(*own, "side", inside.alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    value = F.when(F.col("side") == -1, F.col("most")).otherwise(F.col("least"))
    upto = F.sum("n").over(Window.partitionBy("feature", "share").orderBy("side", "v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.select(*own, value.alias("v"), upto.alias("upto"))
    whole = F.floor("at")
    found = ranked.groupBy(*own).agg(
        F.min(F.when(F.col("upto") > whole, F.col("v"))).alias("low"), F.min(F.when(F.col("upto") > F.ceil("at"), F.col("v"))).alias("high")
    )
    rest = F.col("at") - whole
    return found.select("feature", "share", F.when(rest == 0, F.col("low")).otherwise((1 - rest) * F.col("low") + rest * F.col("high")).alias("value"))


def scale_parameters(df: DataFrame) -> DataFrame:
    """Median and interquartile range of each column; a range of 0 counts as 1."""
    at = lambda p: F.max(F.when(F.col("share") == p, F.col("value")))
    spread = at(0.75) - at(0.25)
    return quantiles(df, (0.25, 0.5, 0.75)).groupBy("feature").agg(at(0.5).alias("centre"), F.when(spread == 0, 1.0).otherwise(spread).alias("spread"))


def robust_scaled(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns as (x - median) / interquartile range; others stay."""
    columns = columns or df.columns
    known = {r["feature"]: r for r in scale_parameters(df.select(*columns)).collect()}
    return df.select(*[((F.col(c) - known[c]["centre"]) / known[c]["spread"]).alias(c) if c in known else F.col(c) for c in df.columns])


def unscaled(x: Column, centre: Column, spread: Column) -> Column:
    return x * spread + centre


def metrics(df: DataFrame, truth: Column, guess: Column, by: list[str]) -> DataFrame:
    """R² and RMSE of predictions in each group; the mean is found first, for accuracy."""
    pairs = df.select(*by, truth.alias("y"), guess.alias("p"))
    means = pairs.groupBy(*by).agg(F.avg("y").alias("m"))
    joined = pairs.join(means, by) if by else pairs.crossJoin(means)
    off, total = F.sum(F.pow(F.col("y") - F.col("p"), F.lit(2))), F.sum(F.pow(F.col("y") - F.col("m"), F.lit(2)))
    return joined.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (1 - off / F.when(total > 0, total)).alias("r2"), F.sqrt(off / F.count(F.lit(1))).alias("rmse"))


def shuffled(df: DataFrame, seed: int) -> Column:
    """A key that puts rows in an order of chance; equal rows get different keys, so none of their buckets is large."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.monotonically_increasing_id() % 4096, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])))


def permutation_importance(df: DataFrame, target: str, names: list[str], predict: Callable[[dict[str, Column]], Column], keys: list[Column] | None = None) -> DataFrame:
    """Drop of R² when one feature's values are dealt anew to the rows: mean and deviation over repeats.

    ``predict`` makes the prediction from a mapping of feature names to
    columns. ``keys`` are hexadecimal hashes of the row, one for the order of
    the rows and one for that of the donors of each repeat; the row at a place
    takes the values of the donor at that place. Each repeat joins rows once.
    """
    keys = keys or [shuffled(df, seed) for seed in range(4)]
    values = [F.col(f"`{n}`").cast("double").alias(f"v{i}") for i, n in enumerate(names)]
    rows = numbered_rows(df.select(F.col(f"`{target}`").cast("double").alias("y"), *values, keys[0].alias("key")), "key").drop("key")
    own = {n: F.col(f"v{i}") for i, n in enumerate(names)}
    mean = df.agg(F.avg(F.col(f"`{target}`").cast("double"))).first()[0]
    off = lambda p: F.sum(F.pow(F.col("y") - p, F.lit(2)))
    drops = None
    for repeat, key in enumerate(keys[1:]):
        donors = numbered_rows(df.select(*[v.alias(f"d{i}") for i, v in enumerate(values)], key.alias("key")), "key").drop("key")
        errors = [off(predict(own | {n: F.col(f"d{i}")})).alias(f"e{i}") for i, n in enumerate(names)]
        sums = rows.join(donors, "at").agg(off(predict(own)).alias("e"), off(F.lit(mean)).alias("total"), *errors)
        cells = F.array(*[F.struct(F.lit(n).alias("feature"), ((F.col(f"e{i}") - F.col("e")) / F.when(F.col("total") > 0, F.col("total"))).alias("drop")) for i, n in enumerate(names)])
        found = sums.select(F.lit(repeat).alias("repeat"), F.inline(cells))
        drops = found if drops is None else drops.unionByName(found)
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("deviation"))


def top_importance(importance: DataFrame, top: int = 10) -> DataFrame:
    """The features of highest importance, best first; ties by name."""
    return importance.orderBy(F.desc("importance"), "feature").limit(top)


def numbered_rows(df: DataFrame, key: str) -> DataFrame:
    """Number rows from 0 in the order of a hexadecimal hash, as ``at``.

    The first digits deal rows to 4,096 buckets of like size; they are
    numbered bucket by bucket, so no task sees all.
    """
    dealt = df.withColumn("__b", F.substring(key, 1, 3))
    counts = dealt.groupBy("__b").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("__b", before.alias("__o")))  # at most 4,096 rows
    inside = Window.partitionBy("__b").orderBy(key)
    ranked = dealt.withColumn("__r", F.row_number().over(inside) - 1)
    return ranked.join(offsets, "__b").withColumn("at", F.col("__r") + F.col("__o")).drop("__b", "__o", "__r")


def shares(importance: DataFrame) -> DataFrame:
    """Positive importances over their sum; no rows if they are all nil."""
    total = F.sum("importance").over(Window.partitionBy())
    good = importance.where("importance > 0")
    return good.withColumn("total", total).where("total > 1e-12").select("feature", (F.col("importance") / F.col("total")).alias("share"))
