"""Constants inside functions: laws that are known, and the sums against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawfinder.functions import tree
from lawfinder.operators import inner


@pytest.fixture(scope="module")
def rows(spark):
    T, z = 300 + 20 * (F.col("id") % 40), 1 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 250.0
    df = spark.range(3000).select(T.cast("double").alias("T"), z.alias("z")).repartition(4)
    laws = {"arrhenius": 5000 * F.exp(-8000 / (8.314 * F.col("T"))), "mixed": 3 * F.exp(-0.7 * F.col("z")) + 0.01 * F.col("T") + 2, "shifted": 4 / (F.col("z") + 2.5) - 1}
    return df.select("*", *[c.alias(n) for n, c in laws.items()]).cache()


def best(spark, rows, target, **given):
    found, passes = inner.fit_constants(spark, rows, target, ["T", "z"], **given)
    return found.orderBy("loss", "complexity").first(), passes


def test_an_arrhenius_law(spark, rows):
    r, passes = best(spark, rows, "arrhenius", most_terms=1)
    assert (r["forms"], r["features"]) == (["exp_inverse"], ["T"]) and abs(r["constants"][0] + 8000 / 8.314) < 1e-6 * 962
    assert abs(r["coefficients"][0] - 5000) < 1e-3 and r["r2"] > 1 - 1e-12 and passes <= 14


def test_two_terms_and_the_text(spark, rows):
    r, passes = best(spark, rows, "mixed")
    found = dict(zip(zip(r["forms"], r["features"], strict=True), zip(r["constants"], r["coefficients"], strict=True), strict=True))
    assert set(found) == {("exp", "z"), ("raw", "T")} and passes <= 26
    assert np.allclose([found["exp", "z"][0], found["exp", "z"][1], found["raw", "T"][1], r["intercept"]], [-0.7, 3, 0.01, 2], rtol=1e-5)
    text = spark.createDataFrame([(r["equation"],)], "e string").select(tree.value(tree.parsed(F.col("e")), lambda n: F.when(n == "T", 400.0).otherwise(2.0)).alias("v")).first()["v"]
    assert abs(text - (3 * np.exp(-1.4) + 6)) < 1e-6


def test_allowed_functions(spark, rows):
    r, _ = best(spark, rows, "shifted", functions={"/", "log"}, most_terms=1)
    assert r["forms"] == ["inverse"] and abs(r["constants"][0] - 2.5) < 1e-5
    r, _ = best(spark, rows, "shifted", functions={"log"}, most_terms=1)
    assert r["forms"][0] in ("log", "raw")


def test_steps_are_those_of_the_projected_jacobian(spark, rows):
    """Against numpy on the rows themselves, by differences of the best line's residuals."""
    data = rows.toPandas()
    y, constants = data["mixed"].to_numpy(), np.array([-0.5, 0.001])

    def residual(b):
        v = np.column_stack([np.exp(b[0] * data["z"]), np.exp(b[1] * data["T"]), np.ones(len(data))])
        return y - v @ np.linalg.lstsq(v, y, rcond=None)[0]

    model = inner.Model((("exp", "z"), ("exp", "T")), constants)
    mean, cov = inner._moments(rows, "mixed", ["T", "z"], [(0, model)], [constants])[0]
    loss, a, intercept, step = inner._solved(mean, cov, 2)
    assert np.isclose(loss, (residual(constants) ** 2).mean(), rtol=1e-8)
    gradient = np.array([((residual(constants + h) ** 2).mean() - (residual(constants - h) ** 2).mean()) / 2e-6 for h in np.eye(2) * 1e-6])
    assert gradient @ step < 0  # downhill
    better = [(residual(constants + c * step) ** 2).mean() for c in (1, 0.25, 0.0625)]
    assert min(better) < loss


def test_odd_columns(spark):
    rows = [(float(i), None if i == 3 else 1.0, float("inf") if i == 5 else float(i), 2.0 * i) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "a double, flat double, wild double, y double").where("flat is not null")
    found, _ = inner.fit_constants(spark, df, "y", ["a", "flat", "wild"], most_terms=1)
    r = found.orderBy("loss", "complexity").first()
    assert r["features"] == ["a"] and r["r2"] > 1 - 1e-9
    assert inner.fit_constants(spark, df.limit(0), "y", ["a"], most_terms=2)[0].count() == 0


def test_rows_in_one_file_are_spread_and_sums_stay_small(spark, rows, tmp_path):
    """All rows go through every pass in several tasks, though they come from one; what is joined has a row per model and task."""
    rows.select("T", "z", "mixed").coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert one.rdd.getNumPartitions() == 1
    asked = []
    plain = inner._moments

    def seen(df, *given):
        asked.append(df.rdd.getNumPartitions())
        return plain(df, *given)

    inner._moments = seen
    try:
        found, _ = inner.fit_constants(spark, one, "mixed", ["T", "z"], {"exp"}, most_terms=1)
    finally:
        inner._moments = plain
    assert min(asked) >= 2 and found.count() > 0


def test_a_null_has_no_value_in_any_form(spark):
    """A null was taken for the greatest argument of an exponential."""
    df = spark.createDataFrame([(float(i) if i else None, float(i)) for i in range(20)], "a double, y double")
    models = [(k, inner.Model(((form, "a"),), np.array([0.1]))) for k, form in enumerate(("exp", "raw", "sin"))]
    assert inner._moments(df, "y", ["a"], models, [m.constants for _, m in models]) == {0: None, 1: None, 2: None}


def test_equal_rows_are_gone_through_once(spark, rows):
    """Copies of rows count as often as they occur, and the sums go over different rows alone."""
    few = rows.select("T", "z", "mixed").limit(400).cache()
    uneven = few.unionByName(few.where("T < 600")).unionByName(few.where("T < 600"))
    models = [(0, inner.Model((("exp", "z"),), np.array([-0.5])))]
    grouped = uneven.groupBy("T", "z", "mixed").agg(F.count(F.lit(1)).alias("n"))
    plain, once = (inner._moments(d, "mixed", ["T", "z"], models, [models[0][1].constants], *of)[0] for d, *of in ((uneven,), (grouped, "n")))
    assert np.allclose(plain[0], once[0], rtol=1e-12) and np.allclose(plain[1], once[1], rtol=1e-9)
    counted, whole = [], inner._moments
    inner._moments = lambda df, *given: counted.append(df.count()) or whole(df, *given)
    try:
        inner.fit_constants(spark, uneven, "mixed", ["T", "z"], {"/"}, most_terms=1)
    finally:
        inner._moments = whole
    assert set(counted) == {few.distinct().count()}
