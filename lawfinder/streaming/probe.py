"""Grammar probing of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.stats import transform_matrix


def running_matrix(stream: DataFrame, target: str) -> DataFrame:
    """R² of each transform of each feature so far, for an output in complete or update mode.

    The state is that of Spark's own regression aggregates, which keep means
    and centred moments: one row per transform and feature, however many rows
    arrive.
    """
    return transform_matrix(stream, target)
