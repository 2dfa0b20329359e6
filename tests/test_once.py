"""Work on texts is done once for each different text, not for each row or in the task that reads the rows."""

from pyspark.sql import functions as F

from lawfinder.operators import equivalence
from lawfinder.queries import QUERIES


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_classes_are_found_from_different_formulas_alone(spark):
    df = spark.range(600).select("id", F.element_at(F.array(*map(F.lit, ["(x + 1)^2", "x^2 + 2*x + 1", "x*y", "bad((", None])), (F.col("id") % 5 + 1).cast("int")).alias("s")).coalesce(1)
    found = equivalence.equivalent(df, "s", "id")
    assert "lambdafunction" not in _plan(found)
    assert {(r["id"] % 5, r["class_key"]) for r in found.collect()} == {(0, 0), (1, 0), (2, 2), (3, None), (4, None)}
    assert found.count() == 600


SF = "/root/testdata/sf0.001"


def _is_read_only(spark, query):
    """Whether nothing is left to do on the formulas' text once their number is known."""
    plan = _plan(QUERIES[query](spark, SF))
    return "regexp_" not in plan and "aggregate(" not in plan


def test_expansion_and_trees_of_different_formulas_alone(spark):
    assert _is_read_only(spark, "formula_expansion")
    assert _is_read_only(spark, "formula_trees")



def test_formula_agreement_from_different_formulas_alone(spark):
    assert "regexp_extract_all" not in _plan(QUERIES["formula_agreement"](spark, SF))



def test_formula_costs_from_different_formulas_alone(spark):
    assert "regexp_extract_all" not in _plan(QUERIES["formula_costs"](spark, SF))



def test_formula_terms_from_different_formulas_alone(spark):
    assert "regexp_extract_all" not in _plan(QUERIES["formula_terms"](spark, SF))



def test_formula_matches_from_different_formulas_alone(spark):
    assert "regexp_extract_all" not in _plan(QUERIES["formula_matches"](spark, SF))



def test_formula_likeness_from_different_formulas_alone(spark):
    assert "regexp_extract_all" not in _plan(QUERIES["formula_likeness"](spark, SF))



def test_formula_signatures_from_different_formulas_alone(spark):
    assert "regexp_extract_all" not in _plan(QUERIES["formula_signatures"](spark, SF))



def test_formula_normal_forms_from_different_formulas_alone(spark):
    assert "regexp_" not in _plan(QUERIES["formula_normal_forms"](spark, SF))
