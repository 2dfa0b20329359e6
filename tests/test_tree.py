"""Trees of formulas: against a small reader of their own, hand-written forms, and values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lawfinder.functions import tree
from lawfinder.operators import equivalence, similarity

FUNCTIONS = ("exp", "log", "sqrt", "sin", "tanh")


def grown(rng, depth):
    """A random tree as (postfix, text with brackets everywhere, value at 1.5 or None)."""
    if depth == 0 or rng.random() < 0.15:
        leaf = rng.choice(["x", "y_1", "sqrtd", "k2", "2", "0.5", "1.5e-3", "7"])
        return [leaf], leaf
    kind = rng.random()
    if kind < 0.2:
        t, s = grown(rng, depth - 1)
        f = rng.choice(FUNCTIONS)
        return [*t, f], f"{f}({s})"
    if kind < 0.3:
        t, s = grown(rng, depth - 1)
        return [*t, "~"], f"(-{s})"
    (a, s), (b, r) = grown(rng, depth - 1), grown(rng, depth - 1)
    op = rng.choice(tree.BINARY)
    return [*a, *b, op], f"({s}{rng.choice(['', ' '])}{op} {r})"


@pytest.fixture(scope="module")
def formulas():
    rng = random.Random(9)
    return [grown(rng, rng.choice([1, 2, 3, 4])) for _ in range(10_000)]


def test_ten_thousand_formulas_come_back(spark, formulas):
    df = spark.createDataFrame([(" ".join(t), s) for t, s in formulas], "expected string, s string").repartition(8)
    once = df.withColumn("t", tree.parsed(F.col("s")))
    again = once.withColumn("p", tree.printed(F.col("t"))).withColumn("t2", tree.parsed(F.col("p")))
    bad = again.where("coalesce(array_join(t, ' '), '') <> expected or coalesce(array_join(t2, ' '), '') <> expected").select("s", "p", "expected").collect()
    assert not bad[:5]


# Hand-written: text, tree, shortest text.
FORMS = [
    ("a*exp(-x)", "a x ~ exp *", "a*exp(-x)"), ("-x^2", "x 2 ^ ~", "-x^2"), ("2^-x*y", "2 x ~ ^ y *", "2^(-x)*y"), ("a - (b - c)", "a b c - -", "a - (b - c)"), ("(a - b) - c", "a b - c -", "a - b - c"),
    ("a/(b*c)/d", "a b c * / d /", "a/(b*c)/d"), ("log x^2 + k T", "x 2 ^ log k T * +", "log(x^2) + k*T"), ("3x(y+1)", "3 x * y 1 + *", "3*x*(y + 1)"), ("a^b^c", "a b c ^ ^", "a^b^c"), ("(a^b)^c", "a b ^ c ^", "(a^b)^c"),
    ("a++b", "a b +", "a + b"), ("sin(a)^2", "a sin 2 ^", "sin(a)^2"), ("x**2", "x 2 ^", "x^2"), ("[a+b]*{c}", "a b + c *", "(a + b)*c"), (".5x", ".5 x *", ".5*x"), ("E_0 (T)", "E_0 T *", "E_0*T"), ("((a))", "a", "a"),
    ("exp(", None, None), ("x +", None, None), ("", None, None), ("é + 1", None, None), ("a) + (b", None, None), ("()", None, None), ("* a", None, None), ("a = b", None, None), (None, None, None), ("exp", None, None),
]


def test_hand_written_forms(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(FORMS)], "i int, s string").withColumn("t", tree.parsed(F.col("s")))
    for r in df.select("i", F.array_join("t", " ").alias("t"), tree.printed(F.col("t")).alias("p")).collect():
        assert (r["t"], r["p"]) == FORMS[r["i"]][1:], FORMS[r["i"]]


def test_values(spark, formulas):
    env = {"x": 1.3, "y_1": 0.7, "sqrtd": 2.1, "k2": 0.4}

    def value(t):
        stack = []
        for x in t:
            if x in tree.BINARY:
                b, a = stack.pop(), stack.pop()
                stack.append({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "^": lambda: math.pow(a, b)}[x]())
            elif x == "~":
                stack.append(-stack.pop())
            elif x in FUNCTIONS:
                stack.append(getattr(math, x)(stack.pop()))
            else:
                stack.append(env.get(x) if x in env else float(x))
        return stack[0]

    some = formulas[:2000]
    of = lambda n: F.coalesce(*[F.when(n == k, F.lit(v)) for k, v in env.items()])
    found = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(some)], "i int, s string").select("i", tree.value(tree.parsed(F.col("s")), of).alias("v")).collect()
    compared = 0
    for r in found:
        try:
            expected = value(some[r["i"]][0])
        except (ValueError, ZeroDivisionError, OverflowError):
            continue
        assert math.isclose(r["v"], expected, rel_tol=1e-9, abs_tol=1e-12) or not math.isfinite(expected), some[r["i"]]
        compared += 1
    assert compared > 1500


def test_names_are_put_back_once(spark):
    plan = {"x0": "sigma_0", "x1": "1/sqrt(x10)", "x10": "a + b", "x2": "x1"}
    eqs = {"x10*x1 - x0": "(a + b)*(1/sqrt(x10)) - sigma_0", "exp(x2)^x1": "exp(x1)^(1/sqrt(x10))", "x0x1": "x0x1", "no(": "no(", "max1 + x1": "max1 + 1/sqrt(x10)"}
    df = spark.createDataFrame([(k, v) for k, v in eqs.items()], "s string, e string")
    for r in df.withColumn("h", tree.humanised(F.col("s"), plan)).collect():
        assert r["h"] == r["e"]


def test_parts_and_nesting(spark):
    cases = [("k/sqrtd", "d", False), ("k/sqrt(d)", "d", True), ("k/sqrt(d)", "sqrt(d)", True), ("a + b*c", "b*c", True), ("a*b + c", "b + c", False), ("a - b - c", "b - c", False), ("x", "x*x", False)]
    df = spark.createDataFrame(cases, "s string, p string, e boolean")
    for r in df.withColumn("f", tree.contains(tree.parsed(F.col("s")), tree.parsed(F.col("p")))).collect():
        assert r["f"] is r["e"], r
    nests = [("exp(exp(x))", True), ("exp(a*sqrt(exp(x)))", True), ("exp(x)*exp(y)", False), ("(x^2 + 1)^3", True), ("x^(y^2)", True), ("x^2*y^3", False), ("exp(x^2)^2", True), ("sqrt(x)^2", False)]
    df = spark.createDataFrame(nests, "s string, e boolean")
    for r in df.withColumn("f", tree.nested(tree.parsed(F.col("s")))).collect():
        assert r["f"] is r["e"], r
    args = spark.createDataFrame([("exp(a*sqrt(b)) + log(2) + c",)], "s string").select(tree.arguments(tree.parsed(F.col("s"))).alias("a")).first()["a"]
    assert [(a["function"], a["names"]) for a in args] == [("sqrt", ["b"]), ("exp", ["a", "b"]), ("log", [])]


# Hand-written: what multiplying out gives.
OUT = {
    "(a+b)*(c-d)": "a*c - a*d + b*c - b*d", "(a+b)^2": "a^2 + 2*a*b + b^2", "2*(x+3)*(x-3)": "2*x^2 - 18", "(a+b)/c": "a/c + b/c", "x/(a+b)": "x/(a + b)", "exp(-(a+b)*2)": "exp(-2*a - 2*b)",
    "(x+1)^5": "(x + 1)^5", "(a+b)^0.5*2": "2*(a + b)^0.5", "x*x/x": "x", "(x + y)*0.5": "0.5*x + 0.5*y", "x/2": "x/2", "2*x/4": "x/2", "0*x + y": "y", "a-(b-c)": "a - b + c", "log10(x)*(a+b)": "log10(x)*(a+b)",
    "(a+b)*c/(e*f)": "a*c/(e*f) + b*c/(e*f)", "3*(k/sqrt(d) + 2)": "3*k/sqrt(d) + 6", "-(x+1)*2": "-2*x - 2", "x^-2*(x+1)": "1/x + 1/x^2", "x - x": "0", "(a+b)*(a-b) - a^2": "-b^2", "a + é": "a + é", "x/0": "x/0",
    "(a+b+c+d+e)*(f+g+h+i+j)*(k+l+m+n)": "(a+b+c+d+e)*(f+g+h+i+j)*(k+l+m+n)", "(1 - v^2/c^2)^(-1/2)": "(1 - v^2/c^2)^(-1/2)", "(x+1)^0": "1",
}


def test_multiplied_out(spark):
    df = spark.createDataFrame(list(OUT.items()), "s string, e string")
    for r in df.withColumn("f", tree.expanded(F.col("s"))).collect():
        assert r["f"] == r["e"], r["s"]


def test_multiplying_out_keeps_values(spark, formulas):
    df = spark.createDataFrame([(s,) for t, s in formulas[:1000] if len(t) < 12][:25], "s string").repartition(8)
    both = df.select("s", tree.expanded(F.col("s")).alias("e"), tree.parsed(F.col("s")).alias("a")).withColumn("b", tree.parsed(F.col("e")))
    # A filter would be moved below the columns and bring their definitions along, once per use.
    good = F.col("b").isNotNull() & F.coalesce(_agree(F.col("a"), F.col("b")), F.lit(True))
    assert not [r for r in both.select("s", "e", good.alias("good")).collect() if not r["good"]][:5]


def _agree(a, b):
    """At three points, where both have values that did not cancel."""
    pairs = [(tree.value(a, lambda n, s=s: tree.point(n, s)), tree.value(b, lambda n, s=s: tree.point(n, s))) for s in range(3)]
    good = lambda x: ~F.isnan(x) & (F.abs(x) < 1e12) & (F.abs(x) > 1e-6)
    out = F.lit(True)
    for x, y in pairs:
        out = out & (~good(x) | ~good(y) | (F.abs(x - y) <= 1e-6 * F.abs(x)))
    return out


def test_equal_functions_share_a_class(spark):
    rows = ["(x+1)^2", "x^2 + 2*x + 1", "x^2+2*x+1.000001", "x*x+x+x+1", "sin(x)^2+cos(x)^2", "1", "exp(a)*exp(b)", "exp(a+b)", "log(x*y)", "log(x)+log(y)", "y", "0", "x-x", "sin(x)^2 + cos(x)^2 - 1", "sqrt(-1-x)", "bad((", "(x+1)^2", None]
    expected = [0, 0, 2, 0, 4, 4, 6, 6, 8, 8, 10, 11, 11, 11, 14, None, 0, None]
    df = spark.createDataFrame([(i, r, "clash") for i, r in enumerate(rows)], "i long, s string, class string")
    assert [r["class_key"] for r in equivalence.equivalent(df, "s", "i").orderBy("i").collect()] == expected


def test_exact_match_with_unshared_names_as_one(spark):
    cases = [("k/sqrt(d)", "A*d^(-1/2)", True), ("a*x + b", "x", False), ("a*x+b", "x+c", True), ("log10(x)", "x", None), ("x", "y", True), ("x^2", "x^3", False), ("x(", "x", None), ("sqrt(-x)", "sqrt(-x)", None), ("exp(x)^2", "exp(2*x)", True)]
    df = spark.createDataFrame(cases, "a string, b string, e boolean")
    for r in df.withColumn("m", tree.exact_match(F.col("a"), F.col("b"))).collect():
        assert r["m"] is r["e"], r


def test_influence_by_arguments(spark):
    features = spark.createDataFrame([("d", "d", 0.2), ("k", "k", 0.5), ("isd", "1/sqrt(d)", 0.3)], "feature string, formula string, share double")
    eqs = spark.createDataFrame([(1, "2*exp(d) + k"), (2, "k/sqrtd"), (3, "k*(1/sqrt(d)) - 1"), (4, "log10(k*exp(z))"), (5, "oops(")], "equation_id int, e string")
    found = {(r["equation_id"], r["op"]): round(r["influence"], 9) for r in similarity.carried(eqs, "e", features, ["equation_id"]).collect()}
    assert found == {
        (1, "exp"): 0.5, (1, "*"): 0.7, (1, "+"): 0.7,  # exp carries both features of d
        (2, "/"): 0.5,
        (3, "sqrt"): 0.5, (3, "/"): 1.0, (3, "*"): 1.0, (3, "-"): 1.0,
        (4, "log"): 0.5, (4, "*"): 0.5,
    }


def test_terms_counted_after_multiplying_out(spark):
    df = spark.createDataFrame([("0.5*(x + sqrt(d))",), ("(a + b)*(c - d)/e",), ("log10(x)*(a + b)",)], "f string")
    shapes = lambda expand: [dict(r["sig"]["term_shapes"]) for r in similarity.with_signature(df, "f", expand=expand).collect()]
    assert shapes(False) == [{"sqrt": 1}, {"div": 1}, {"log": 1}]
    assert shapes(True) == [{"linear": 1, "sqrt": 1}, {"div": 4}, {"log": 1}]
