"""Datasets: reading, validation and the numeric projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

MIN_ROWS, MIN_COLUMNS = 10, 2
#: Spellings of a missing value in text files.
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "<NA>")


class DatasetError(ValueError):
    """A dataset that cannot be analysed; the message says why."""


def read(spark: SparkSession, path: str) -> DataFrame:
    """Read Parquet, or a CSV with a header whose numeric columns may spell missing values in several ways."""
    try:
        if path.rstrip("/").endswith(".parquet"):
            return spark.read.parquet(path)
        text = spark.read.option("header", True).csv(path)
    except Exception as error:
        raise DatasetError(f"could not read {path}: {error}") from error
    missing = lambda c: F.trim(c).isin(*MISSING) | c.isNull()
    cols = [F.col(f"`{c}`") for c in text.columns]
    numeric = text.agg(*[
        (F.bool_and(missing(c) | c.try_cast("double").isNotNull()) & F.bool_or(~missing(c))).alias(str(i)) for i, c in enumerate(cols)
    ]).first()
    return text.select(*[
        F.when(~missing(c), c.try_cast("double")).alias(name) if numeric[str(i)] else c for i, (c, name) in enumerate(zip(cols, text.columns, strict=True))
    ])


def complete_numeric(df: DataFrame) -> DataFrame:
    """Numeric columns as doubles, without rows that miss any of them; infinities stay."""
    names = [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
    whole = df.select(*[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    return whole.na.drop() if names else whole


def validated(df: DataFrame, target: str | None) -> DataFrame:
    """The complete numeric part of ``df``, checked for the target and for size."""
    target = (target or "").strip()
    if not target:
        raise DatasetError("name the target column")
    if target not in df.columns:
        raise DatasetError(f"no column {target}; there are {', '.join(df.columns)}")
    rows = complete_numeric(df)
    if target not in rows.columns:
        raise DatasetError(f"column {target} is not numeric")
    if len(rows.columns) < MIN_COLUMNS:
        raise DatasetError("a target and at least one more numeric column are needed")
    if rows.limit(MIN_ROWS).count() < MIN_ROWS:
        raise DatasetError(f"at least {MIN_ROWS} complete rows are needed")
    return rows


def capped(df: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """At most ``rows`` rows in a fixed pseudo-random order; the same rows however the data are partitioned."""
    key = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])
    return df.orderBy(key, *[F.col(f"`{c}`") for c in df.columns]).limit(rows)


def features_of(df: DataFrame, target: str) -> list[str]:
    return [c for c in df.columns if c != target]


def numeric_profile(df: DataFrame) -> DataFrame:
    """Per numeric column: rows, missing, least, population deviation, whether all positive or near constant."""
    long = long_form(df)
    value = F.col("x")
    ok = value.isNotNull() & ~F.isnan(value)
    return long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~ok | value.isNull(), 1)).alias("n_missing"),
        F.min(F.when(ok, value)).alias("least"), F.stddev_pop(F.when(ok, value)).alias("deviation"),
    ).withColumn("positive", F.col("least") > 0).withColumn("near_constant", F.col("deviation") < 1e-10)


def long_form(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per (row, feature) with value ``x``; columns in ``keep`` stay beside."""
    keep = keep or []
    names = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in keep]
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").cast("double").alias("x")) for n in names])
    return df.select(*[F.col(f"`{k}`") for k in keep], F.inline(cells))
