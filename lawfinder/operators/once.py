"""What a text gives, worked out once for each different text.

Formulas repeat from row to row, and a file of them is small enough to be one
task. So the different ones are spread over tasks by their number, not by
their bytes, and what they give is written down: read back, it is neither
worked out again for each use nor moved, with a filter on it, below the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows by hash over all tasks of a shuffle; adaptive execution keeps that number, however few the bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[F.col(f"`{b}`") for b in by])


def of_each(df: DataFrame, texts: list[str], **made: Callable[..., Column]) -> DataFrame:
    """The different values of the columns ``texts``, nulls among them, each with what is made of them."""
    each = spread(df.select(*[F.col(f"`{t}`") for t in texts]).distinct(), *texts)
    return cut(each.select("*", *[make(*[F.col(f"`{t}`") for t in texts]).alias(name) for name, make in made.items()]))


def beside(df: DataFrame, found: DataFrame, texts: list[str]) -> DataFrame:
    """``df`` with the columns of ``found`` for its texts; a null is equal to a null."""
    other = found.withColumnsRenamed({t: f"__of_{t}" for t in texts})
    on = [F.col(f"`{t}`").eqNullSafe(F.col(f"`__of_{t}`")) for t in texts]
    return df.join(other, on).drop(*[f"__of_{t}" for t in texts])


def with_each(df: DataFrame, text: str, **made: Callable[[Column], Column]) -> DataFrame:
    """``df`` with columns made of a text."""
    return beside(df, of_each(df, [text], **made), [text])
