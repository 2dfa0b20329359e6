"""Probes per group against a loop over groups, features and functions."""

import math
import random

import numpy as np
from lawfinder.operators import probe, rank
from lawfinder.sources import grammars
from pyspark.sql import functions as F

SCHEMA = "site string, a double, b double, y double, note string"
PLAIN = {
    "raw": lambda v: v, "log": lambda v: math.log(abs(v) + 1e-9), "log10": lambda v: math.log10(abs(v) + 1e-9), "exp": lambda v: math.exp(max(-50.0, min(50.0, v))),
    "sqrt": lambda v: math.sqrt(abs(v)), "sin": math.sin, "cos": math.cos, "tan": math.tan, "sinh": math.sinh, "cosh": math.cosh, "tanh": math.tanh,
}


def rows():
    rng = random.Random(4)
    laws = {"hot": lambda a, b: 2 * math.sqrt(a) + 1, "cold": lambda a, b: math.sin(b), None: lambda a, b: 3 * a - 2, "mixed": lambda a, b: math.exp(-b) + 0.1 * a}
    out = []
    for site, law in laws.items():
        for _ in range(900 if site == "hot" else 60):
            a, b = rng.uniform(0.5, 9), rng.uniform(0.1, 3)
            out.append((site, a, b, law(a, b) + rng.gauss(0, 0.01), "n"))
    return [*out, ("hot", 4.0, 1.0, None, "n"), ("two", 1.0, 2.0, 3.0, "n"), ("two", 2.0, 1.0, 5.0, None)]


def brute(data, ops):
    found = {}
    for site in {r[0] for r in data}:
        own = [r for r in data if r[0] == site and r[3] is not None]
        y = np.array([r[3] for r in own])
        fit = {}
        for k, feature in ((1, "a"), (2, "b")):
            for op, f in PLAIN.items():
                v = np.array([f(r[k]) for r in own])
                fit[feature, op] = 0.0 if len(own) < 3 else max(0.0, np.corrcoef(v, y)[0, 1] ** 2)
        for cid in {c for c, *_ in ops}:
            allowed = [("raw", 0.1), *[(op, w) for c, op, w in ops if c == cid]]
            order = lambda c: (-round(c[2], 5), c[3], -c[4], c[0], c[1])
            feature, op, r2, nodes, w = min(((f, op, fit[f, op], 5.0 + (op != "raw"), w) for f in "ab" for op, w in allowed), key=order)
            found[site, cid] = (feature, op, r2, (1 - r2) * y.var(), nodes, w)
    return found


def test_best_function_of_each_group_and_grammar(spark):
    data, table = rows(), grammars.operator_table(grammars.builtin(spark))
    ops = [(r["cluster_id"], r["op"], r["weight"]) for r in table.where("arity = 1 and weight > 0").collect()]
    got = probe.grouped_probes(spark.createDataFrame(data, SCHEMA), "y", ["site"], table).collect()
    want = brute(data, ops)
    assert len(got) == len(want)
    for r in got:
        feature, op, r2, loss, nodes, w = want[r["site"], r["cluster_id"]]
        assert (r["feature"], r["op"], r["complexity"], r["compatibility"]) == (feature, op, nodes, w), (r, want[r["site"], r["cluster_id"]])
        assert math.isclose(r["r2"], r2, abs_tol=1e-9) and math.isclose(r["loss"], loss, abs_tol=1e-9)
    by = {(r["site"], r["cluster_id"]): (r["feature"], r["op"]) for r in got}
    assert by["hot", "0"] == ("a", "sqrt") and by["cold", "0"] == ("b", "sin") and by[None, "0"] == ("a", "raw")


def test_ranks_restart_in_each_group(spark):
    table = grammars.operator_table(grammars.builtin(spark))
    probes = probe.grouped_probes(spark.createDataFrame(rows(), SCHEMA), "y", ["site"], table)
    ranked = rank.best_runs(probes, ["site"])
    sizes = ranked.groupBy("site").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.countDistinct("place").alias("n")).collect()
    assert len(sizes) == 5 and all((r["first"], r["last"], r["n"]) == (1, 13, 13) for r in sizes)
    for r in ranked.where("site = 'hot' and place = 1").collect():
        want = max((p["compatibility"], p["cluster_id"]) for p in probes.where("site = 'hot' and op = 'sqrt'").collect())
        assert (r["compatibility"], r["cluster_id"]) == want


def test_empty_table(spark):
    table = grammars.operator_table(grammars.builtin(spark))
    assert probe.grouped_probes(spark.createDataFrame([], SCHEMA), "y", ["site"], table).count() == 0
