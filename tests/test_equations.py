"""Rules for datasets, grammars, equation text and similarity on small fixtures."""

import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawfinder.functions import text
from lawfinder.functions.transforms import adjusted_r2, confidence, quality_label
from lawfinder.operators import catalog, features, fit, probe, rank, similarity, stats
from lawfinder.plans import discover
from lawfinder.sources import dataset, grammars, library


@pytest.fixture(scope="module")
def ops(spark):
    return grammars.operator_table(grammars.builtin(spark)).cache()


@pytest.fixture(scope="module")
def hall_petch(spark):
    return spark.createDataFrame([(i / 7 + 0.5, 70 + 20 / math.sqrt(i / 7 + 0.5)) for i in range(30)], "d double, sigma double")


@pytest.fixture(scope="module")
def arrhenius(spark):
    rows = [(300.0 + 20 * i, 1 / (300.0 + 20 * i), 5000 * math.exp(-8000 / (8.314 * (300 + 20 * i)))) for i in range(40)]
    return spark.createDataFrame(rows, "T double, inv_T double, k double")


def value(spark, column, **literals):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()], F.lit(1).alias("__one")).select(column.alias("v")).first()["v"]


SCORES = {
    "hall_petch": [0.692421, 0.822056, 0.802792, 0.614842, 0.884325, 0.615769, 0.742615, 0.942619, 0.482841, 0.604020, 0.667405, 0.629884, 0.314498],
    "arrhenius": [0.95, 0.96424, 0.96973, 0.922085, 0.994727, 0.934424, 0.981234, 0.988725, 0.930586, 0.940751, 0.863173, 0.913615, 0.949198],
}


@pytest.mark.parametrize("name, target, winner", [("hall_petch", "sigma", "7"), ("arrhenius", "k", "4")])
def test_fast_probe_scores(spark, ops, request, name, target, winner):
    found = probe.fast_probe(request.getfixturevalue(name), target, grammars.builtin(spark), ops).collect()
    assert {int(r["cluster_id"]): round(r["score"], 6) for r in found} == pytest.approx(dict(enumerate(SCORES[name])), abs=2e-6)
    assert [r["cluster_id"] for r in found if r["wins"]] == [winner]


def test_grammar_tables(spark, ops):
    known = grammars.builtin(spark)
    assert known.count() == 13 and known.agg(F.sum("equation_count")).first()[0] == 1324
    rows = ops.collect()
    binary = {(r["cluster_id"], r["op"]): r["weight"] for r in rows if r["arity"] == 2}
    assert all(sum(c == str(i) for c, _ in binary) == 5 for i in range(13)) and binary["12", "*"] == 0.1 and binary["0", "-"] == 0.1
    unary = {(r["cluster_id"], r["op"]): r["weight"] for r in rows if r["arity"] == 1}
    assert unary["7", "log"] == pytest.approx(46 / 66) and unary["7", "log10"] == pytest.approx(13 / 66)
    assert all(sum(w for (c, _), w in unary.items() if c == str(i)) == pytest.approx(1) for i in range(13))
    cost = {(r["cluster_id"], r["op"]): r["cost"] for r in grammars.operator_costs(ops).collect()}
    want = {"0": {"/": 1, "^": 2, "+": 3, "*": 4, "-": 4, "log": 3, "exp": 1, "sqrt": 2, "sin": 3, "cos": 4}, "7": {"/": 1, "^": 4, "+": 4, "*": 5, "-": 4, "log10": 4, "log": 1, "sqrt": 4, "tan": 5}, "12": {"/": 2, "^": 3, "+": 4, "-": 4, "*": 4, "tan": 1, "sqrt": 3}}
    for cid, costs in want.items():
        assert {o: c for (i, o), c in cost.items() if i == cid} == costs


def test_grammar_files(spark, tmp_path):
    (tmp_path / "grammar_cluster_4.json").write_text(json.dumps({"equation_count": 9, "operators": {"weights": {"/": 0.5, "%": 1, "+": "bad"}}, "functions": {"whitelist": ["ln", "odd"], "all_functions": {"ln": 3}}}))
    (tmp_path / "mine.json").write_text(json.dumps({"family_label": "Test Family"}))
    (tmp_path / "broken.json").write_text("{ not json")
    (tmp_path / "notes.txt").write_text("{}")
    found = grammars.from_directory(spark, str(tmp_path))
    assert [r["cluster_id"] for r in found.collect()] == ["4", "mine"]
    weights = {(r["cluster_id"], r["op"]): r["weight"] for r in grammars.operator_table(found).collect()}
    assert weights["4", "log"] == 1 and weights["4", "+"] == 0.1 and weights["4", "/"] == 0.5 and ("4", "%") not in weights
    assert weights["mine", "sqrt"] == pytest.approx(1 / 3) and weights["mine", "*"] == 0.1
    assert grammars.from_directory(spark, str(tmp_path / "missing")).count() == 0


def test_csv_and_validation(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c,y\n" + "".join(f"{i},{'NA' if i == 3 else i * 2},t{i},{'inf' if i == 5 else i}\n" for i in range(20)))
    rows = dataset.validated(dataset.read(spark, str(tmp_path / "a.csv")), "y")
    assert rows.columns == ["a", "b", "y"] and rows.count() == 19
    assert rows.agg(F.max("y")).first()[0] == math.inf
    frame = spark.createDataFrame([(i, "x", float(i)) for i in range(20)], "x int, s string, y double")
    for bad, target in ((frame, ""), (frame, "z"), (frame, "s"), (frame.select("y"), "y"), (frame.limit(9), "y")):
        with pytest.raises(dataset.DatasetError):
            dataset.validated(bad, target)
    with pytest.raises(dataset.DatasetError):
        dataset.read(spark, str(tmp_path / "none.csv"))
    first = dataset.capped(frame.select("x", "y"), 5).collect()
    assert first == dataset.capped(frame.select("x", "y").repartition(7), 5).collect() and len(first) == 5


def test_features_follow_sign_and_relevance(spark):
    rows = spark.createDataFrame([(1.0 + i, -1.0 - i, float(i), 7.0, 2 / math.sqrt(1 + i)) for i in range(20)], "p double, n double, z double, k double, y double")
    plan = features.planned(["p", "n", "z", "k"], features.positive_columns(rows, ["p", "n", "z", "k"]))
    names = [f.name for f in plan]
    assert names[:5] == ["p", "inv_sqrt_p", "sqrt_p", "log_p", "n"] and "sqrt_n" not in names and "n_x_inv_sqrt_p" in names and "p_x_inv_sqrt_z" not in names
    _, stay = features.selected(rows, "y")
    assert {"p", "n", "z", "k", "inv_sqrt_p"} <= {f.name for f in stay} and "sqrt_k" not in {f.name for f in stay}
    assert not any(f.kind == "log" for f in features.selected(rows, "y", {"sqrt"})[1])
    with pytest.raises(dataset.DatasetError):
        features.planned(["d", "sqrt_d"], {"d"})


def test_r2_rules(spark):
    rows = spark.createDataFrame([(float(i), 3.0, math.inf if i == 2 else 1.0 * i, 5.0) for i in range(20)], "x double, k double, w double, y double")
    found = {r["feature"]: r["r2"] for r in stats.univariate_r2(rows, "y").collect()}
    assert found == {"x": 1.0, "k": 0.0, "w": 0.0}
    assert value(spark, adjusted_r2(F.lit(0.9), F.lit(30), F.lit(2))) == pytest.approx(0.892593, abs=1e-6)
    assert value(spark, adjusted_r2(F.lit(0.9), F.lit(3), F.lit(2))) is None


@pytest.mark.parametrize("source, want", [
    (r"\sigma_{0}", "sigma_0"), (r"\frac{a}{b} \cdot \sqrt{x}", "(a)/(b) * sqrt(x)"), (r"\log_{10} x", "log10_(10) x"), (r"x^{-1/2}", "x^(-0.5)"),
    (r"\varepsilon + \Gamma", "epsilon + Gamma"), (r"\frac{\frac{a}{b}}{c}", "((a)/(b))/(c)"), ("a**2", "a^2"), (r"a \; b; c", "a   b; c"),
])
def test_normal_form(spark, source, want):
    assert value(spark, text.normalized(F.col("s")), s=source) == want


def test_text_rules(spark):
    v = lambda f, s: value(spark, f(F.col("s")), s=s)
    assert v(text.canonical, r"\sigma = k d^{-1/2}") == " k 1/sqrt(d)" and v(text.canonical, "e^(x)") == "exp(x)"
    assert v(text.operators, "a-b") == [] and v(text.operators, "a - b") == ["-"] and v(text.operators, "-a*b/c^2+1") == ["*", "+", "-", "/", "^"]
    assert v(text.functions, "log10(x) + sinh(y) + asin") == ["log", "sinh"] and v(text.functions, "log10_(10) x") == []
    assert sorted(v(text.exponents, "a^(3/2) + x^2")) == [1.5, 2.0, 3.0]
    assert v(text.variables, "sigma_0 + k_y*d1 + _x + exp(T)") == ["_x", "d", "k", "sigma", "t"]
    assert [v(text.parse_quality, s) for s in ("", "k/sqrt(d)", "λ*T")] == [0.0, 1.0, 0.0]
    assert v(text.parse_quality, r"\vphantom x + yyyyyyyy") == pytest.approx(0.818182, abs=1e-6)
    assert v(text.terms, "a*(b+c) - d/e + (x-y)^2") == ["a*(b+c)", "- d/e", "+ (x-y)^2"]
    assert [v(text.term_shape, s) for s in ("k/sqrt(d)", "log(x)^2", "sinh(x)", "x^(-0.5)", "exp(sin(x))")] == ["sqrt_div", "log_pow", "linear", "sqrt_div", "exp_trig"]
    assert v(text.term_shapes, "a + b*x - 1/c") == {"linear": 2, "div": 1}
    assert v(text.renamed_constants, "x0*-1.5e3 + 2 - k_1 + 0.25^3 - 7.0 + A + 0.25") == "x0*B + 2 - k_1 + C^3 - D + A + C"
    assert v(text.structural_key, "3.5*x + -2/y1") == v(text.structural_key, "0.1*x + 7 / y1") == "C*x+C/y1"
    assert v(text.search_text, "  Hall-Petch_a/b ") == "hall petch a b"
    assert v(lambda c: text.complexity(c), "a + sqrt(b1)*2.5") == 2 + 1 + 2 + 2


def test_similarity_parts(spark):
    m = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert value(spark, similarity.multiset(m(linear=2, sqrt=1), m(linear=1, div=1))) == pytest.approx(0.4)
    assert value(spark, similarity.jaccard(arr(), arr())) == 1.0 and value(spark, similarity.jaccard(arr("a"), arr())) == 0.0
    assert value(spark, similarity.closeness(F.lit(1), F.lit(3), 8.0)) == pytest.approx(0.778801, abs=1e-6)
    assert value(spark, similarity.closeness(F.lit(None).cast("double"), F.lit(3), 3.0)) == 0.5
    sig = text.signature(F.col("s"))
    assert value(spark, similarity.similarity(sig, sig), s="k/sqrt(d) + c") == pytest.approx(1)
    frame = spark.createDataFrame([("a", "k/sqrt(d) + c", "exp(x)*y")], "id string, one string, two string")
    rows = similarity.breakdown(frame.select("id", text.signature(F.col("one")).alias("a"), text.signature(F.col("two")).alias("b")), "a", "b", ["id"]).collect()
    assert [r["part"] for r in rows] == ["term_shapes", "functions", "operators", "exponents", "var_names", "complexity", "var_count"]


def test_compatibility(spark, ops):
    used = spark.createDataFrame([("e", c, o) for c in ("0", "1", "7", "12") for o in ("+", "/", "sqrt")], "equation_id string, cluster_id string, op string")
    found = {r["cluster_id"]: r["compatibility"] for r in similarity.compatibility(used, ops, ["equation_id"]).collect()}
    assert found == pytest.approx({"0": 0.398714, "1": 0.637923, "7": 0.410814, "12": 0.432890}, abs=1e-6)
    none = spark.createDataFrame([], "equation_id string, op string, influence double")
    assert {r["compatibility"] for r in similarity.compatibility(used, ops, ["equation_id"], none).collect()} == {0.0}
    detail = {r["cluster_id"]: r for r in similarity.matched_and_missing(used, ops, ["equation_id"]).collect()}
    assert detail["7"]["matched_functions"] == ["sqrt"] and detail["7"]["missing_functions"] == ["log", "log10", "tan"] and detail["7"]["missing_operators"] == ["*", "-", "^"]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 101, 30_000])
def test_quantiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    columns = {"spread": rng.normal(size=n), "tied": rng.integers(0, 3, n).astype(float)}
    rows = spark.createDataFrame([*zip(*(c.tolist() for c in columns.values()), [None] * n, strict=True), (None, None, None)], "spread double, tied double, gone double")
    found = {(r["feature"], r["share"]): r["value"] for r in stats.quantiles(rows, (0.25, 0.5, 0.75)).collect()}
    assert len(found) == 6
    for (name, share), v in found.items():
        assert v == pytest.approx(np.quantile(columns[name], share), abs=1e-12)


def test_library_search_labels_and_diagnosis(spark):
    known = library.textbook(spark).cache()
    assert {r["cluster"] for r in known.select("cluster").distinct().collect()} == {str(i) for i in range(13)}
    hits = catalog.searched(known, "hall petch", library.SEARCH_FIELDS)
    assert hits.count() == 2 and catalog.searched(known, "hall petch", library.SEARCH_FIELDS, "Waves").count() == 0 and catalog.searched(known, "", library.SEARCH_FIELDS, "Waves").count() == 3
    labels = sorted(r["label"] for r in library.with_labels(hits).collect())
    assert labels == ["[C1]  Hall-Petch Relation  (Strengthening)", "[C1]  Hall-Petch Relation  (Strengthening) #2"]
    first = library.diagnosed(known, "conduction").first()
    assert first["matches"] == 1 and first["quality_label"] == "clean" or first["quality"] < 1
    many = library.diagnosed(known, "a", most=2).collect()
    assert len(many) == 2 and many[0]["matches"] == many[1]["matches"] == catalog.searched(known, "a", library.DIAGNOSE_FIELDS).count() > 2
    profiles = {r["cluster"]: r for r in library.clusters(known).collect()}
    assert profiles["1"]["total"] == 4 and profiles["1"]["top_categories"][0] == "Strengthening" and len(profiles["1"]["samples"]) == 3
    assert library.from_json(spark, "/nowhere/equations.json").count() == 0
    assert value(spark, quality_label(F.lit(0.5))) == "partial debris" and value(spark, confidence(F.lit(None).cast("double"))) == "N/A"


def test_library_file(spark, tmp_path):
    (tmp_path / "lib.json").write_text(json.dumps([{"cluster": 3, "subfield": "s", "latex": "y = \\ln(x)", "functions": ["log"]}, {"cluster": "x", "subfield": "t", "latex": ""}]))
    rows = library.from_json(spark, str(tmp_path / "lib.json")).orderBy("position").collect()
    assert [r["cluster"] for r in rows] == ["3", "x"] and rows[0]["lib_sig"]["functions"] == ["log", "log10"] and rows[1]["quality"] == 0.0 and rows[0]["display_name"] == "Unknown"


def test_recovers_laws(spark, hall_petch, ops):
    wide, plan = features.selected(hall_petch, "sigma")
    best = fit.one_term_fits(wide, "sigma", plan).orderBy("loss").first()
    assert best["feature"] == "inv_sqrt_d" and best["r2"] > 0.999999
    rows = [(0.5 + i / 10, 1 + (i * 7 % 13) / 3) for i in range(60)]
    two = spark.createDataFrame([(x, z, 3 * x + 2 / math.sqrt(z) - 1) for x, z in rows], "x double, z double, y double")
    wide, plan = features.selected(two, "y", threshold=0.0)
    found = fit.forward_search(spark, wide, "y", plan, most_terms=2).orderBy("loss").first()
    assert sorted(found["features"]) == ["inv_sqrt_z", "x"] and found["r2"] > 0.999999
    again = fit.forward_search(spark, wide.repartition(8), "y", plan, most_terms=2).orderBy("loss").first()
    assert again["equation"] == found["equation"]


def test_whole_analyses(spark, hall_petch):
    known = library.textbook(spark).cache()
    scores, run = discover.auto_probe(spark, hall_petch, "sigma", known)
    assert scores.where("wins").first()["cluster_id"] == run.cluster_id == "7"
    best = run.candidates.orderBy("loss", "complexity").first()
    assert best["r2"] > 0.9999 and 0 < best["compatibility"] <= 1 and best["reference_name"] != "Unknown"
    operators = grammars.operator_table(grammars.builtin(spark))
    importance, agreed, near = discover.evidence(spark, hall_petch, "sigma", run, operators, known)
    assert importance.agg(F.max("importance")).first()[0] > 0.1 and 0 < agreed.first()["compatibility"] <= best["compatibility"] + 1e-9 and near.count() == 5
    shown = discover.report(run)
    assert "Grammar C7" in shown and "Equation 1" in shown and "nearest: " in shown
    lines = discover.probe_report(scores).splitlines()
    assert len(lines) >= 14 and lines[1].startswith("  C0: score") and lines[13].startswith("  C12: score")
    few = grammars.builtin(spark).where(F.col("cluster_id").isin("0", "4", "7", "8"))
    probes, runs = discover.research_probe(spark, hall_petch, "sigma", known, few, terms=1)
    winners, merged = discover.top_three(probes, runs)
    assert winners.count() == 3 and merged.select("key").distinct().count() == merged.count() > 0
    assert discover.probe_report(probes).startswith("Research probe") and "C8: combined" in discover.probe_report(probes)
    compared = discover.comparison_report(winners, merged)
    assert "  1. C" in compared and "given by C" in compared
    with pytest.raises(dataset.DatasetError):
        discover.search(spark, hall_petch, "sigma", "99", grammars.operator_table(few), known)


def test_ranking_rules(spark):
    inf = math.inf
    rows = [("0", 1.0, 0.5, 5.0), ("1", 3.0, 0.9, 5.0), ("10", inf, 0.0, inf), ("2", 1.0, 0.5, 5.0)]
    found = {r["cluster_id"]: r for r in rank.research_scores(spark.createDataFrame(rows, "cluster_id string, loss double, compatibility double, complexity double")).collect()}
    assert found["10"]["combined"] == pytest.approx(1.0) and found["0"]["place"] == 1 and found["2"]["near_tie"] and not found["10"]["near_tie"]
    runs = [("0", 0.9, 0.5, 3.0, 1.0), ("1", 0.9000001, 0.6, 9.0, 1.0), ("2", None, None, None, None)]
    assert [r["cluster_id"] for r in rank.best_runs(spark.createDataFrame(runs, "cluster_id string, r2 double, compatibility double, complexity double, loss double")).orderBy("place").collect()] == ["1", "0", "2"]
    cands = [("0", "k", 1.0, 0.5, 0.1, 3.0), ("1", "k", 1.0, 0.6, 0.1, 3.0), ("1", "m", 0.5, 0.1, 0.1, 9.0)]
    top = rank.merged(spark.createDataFrame(cands, "cluster_id string, key string, loss double, compatibility double, similarity double, complexity double")).orderBy("place").collect()
    assert [(r["key"], r["cluster_id"], r["contributed"]) for r in top] == [("m", "1", 2), ("k", "1", 2)]


def test_stream_gives_the_same_matrix(spark, tmp_path, arrhenius):
    from lawfinder.streaming.probe import running_matrix

    arrhenius.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(arrhenius.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = running_matrix(stream, "k").writeStream.outputMode("complete").format("memory").queryName("matrix").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["op"], r["feature"]): r["r2"] for r in spark.table("matrix").collect()}
    want = {(r["op"], r["feature"]): r["r2"] for r in stats.transform_matrix(arrhenius, "k").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_importance_of_an_exact_law_in_many_rows(spark):
    rows = spark.range(20000).select((F.col("id") / 7 + 1).alias("x"), F.pmod(F.xxhash64("id"), F.lit(100)).alias("noise"))
    law = rows.withColumn("y", 3 * F.col("x") + 1)
    found = {r["feature"]: r for r in stats.permutation_importance(law, "y", ["x", "noise"], lambda c: 3 * c["x"] + 1 + 0 * c["noise"]).collect()}
    assert found["x"]["importance"] == pytest.approx(2, abs=0.1) and found["noise"]["importance"] == 0
    same = law.limit(1).crossJoin(spark.range(500)).drop("id")
    assert stats.permutation_importance(same, "y", ["x"], lambda c: c["x"]).first()["importance"] is None
    assert [r["feature"] for r in stats.top_importance(spark.createDataFrame([("a", 0.1), ("b", 0.5), ("c", 0.1)], "feature string, importance double"), 2).collect()] == ["b", "a"]


def test_all_grammars_from_one_reading(spark, tmp_path):
    """A search of several grammars gives each what a search of its own gives, from the same three readings of the data."""
    rows = spark.range(80).select((F.col("id") / 7 + 0.5).alias("d"), F.sqrt(F.col("id") + 1.0).alias("z")).withColumn("y", 70 + 20 / F.sqrt("d") + F.log("z"))
    ops, known = grammars.operator_table(grammars.builtin(spark)), library.textbook(spark)
    every = discover.searches(spark, rows, "y", ["1", "7", "8"], ops, known, 2)
    for c in ("1", "7"):
        own = discover.search(spark, rows, "y", c, ops, known, 2)
        pick = lambda run: sorted((r["equation"], r["complexity"], round(r["compatibility"], 9)) for r in run.candidates.collect())
        assert pick(own) == pick(every[c]) and pick(own)
        assert [tuple(r) for r in own.features.collect()] == [tuple(r) for r in every[c].features.collect()]
    assert every["7"].equations.orderBy("loss").first()["loss"] < 1e-9 < every["1"].equations.orderBy("loss").first()["loss"]  # only one of them has logarithms
    best = every["7"].equations.orderBy("loss").first()
    assert set(best["features"]) == {"inv_sqrt_d", "log_z"} and sum(best["shares"].values()) == pytest.approx(1)
    moments = fit.centred_moments(rows.select("y", (1 / F.sqrt("d")).alias("a"), F.log("z").alias("b")), "y", ["a", "b"])
    plan = [features.Feature("a", "a", "raw", ("a",)), features.Feature("b", "b", "raw", ("b",))]
    drops = fit.expected_importance(moments, plan, ["a", "b"], [20.0, 1.0])
    two = rows.select("y", (1 / F.sqrt("d")).alias("a"), F.log("z").alias("b"))
    real = {r["feature"]: r["importance"] for r in stats.permutation_importance(two, "y", ["a", "b"], lambda c: 70 + 20 * c["a"] + c["b"], [stats.shuffled(two, s) for s in range(5)]).collect()}
    assert drops["a"] == pytest.approx(real["a"], rel=0.3) and drops["b"] == pytest.approx(real["b"], rel=0.3)


def test_search_with_constants_inside(spark):
    rows = spark.range(60).select((300.0 + 10 * F.col("id")).alias("T"), (F.col("id") % 7 + 1.0).alias("z")).withColumn("k", 5000 * F.exp(-962.0 / F.col("T")))
    ops, known = grammars.operator_table(grammars.builtin(spark)), library.textbook(spark)
    run = discover.search(spark, rows, "k", "8", ops, known, 2, constants=1)
    best = run.equations.orderBy("loss").first()
    assert float(re.search(r"exp\(\((.*?)\)/T\)", best["equation"])[1]) == pytest.approx(-962, rel=1e-6) and best["r2"] > 1 - 1e-9
    importance, agreed, _ = discover.evidence(spark, rows, "k", run, ops, known)
    assert {r["feature"] for r in importance.collect()} == {"T"} and importance.first()["importance"] > 0.5
    assert "exp" in fits(run, best["equation_id"]) and 0 < agreed.where("cluster_id = '8'").first()["compatibility"] <= 1
    assert "carried by: " in discover.report(run) and "likeness of its parts: term_shapes" in discover.report(run)


def fits(run, equation_id):
    return run.compatibility.where(F.col("equation_id") == equation_id).first()["matched_functions"]


def test_search_far_from_zero(spark):
    rows = spark.range(400).select((1.7e9 + F.col("id") * 0.5).alias("t"), F.lit(1e6 + 0.1).alias("flat")).withColumn("y", 5 * (F.col("t") - 1.7e9))
    plan = features.planned(["t", "flat"], set())
    best = fit.forward_search(spark, rows, "y", plan).orderBy("loss", "complexity").first()
    assert best["features"] == ["t"] and best["coefficients"][0] == pytest.approx(5) and best["r2"] == pytest.approx(1) and best["loss"] < 1e-9
    assert fit.forward_search(spark, rows, "y", plan).where("array_contains(features, 'flat')").count() == 0


def test_nesting_limits(spark):
    cases = [
        ("exp(exp(x))", True), ("exp(a + (b*exp(c)))", True), ("exp(x) + exp(y)", False), ("x^2 + y^3", False), ("(x^2)^3", True), ("(x + 1)^2", False),
        ("x^(y^2)", True), ("x^2^3", True), ("x^(y + 1)*z^2", False), ("((x^2) + 1)^y", True), ("sqrt(x^2)*(y)^2", False), ("", False), ("))(", False),
    ]
    found = spark.createDataFrame(cases, "s string, want boolean").withColumn("got", text.too_nested(F.col("s")))
    assert [r["s"] for r in found.collect() if r["got"] is not r["want"]] == []


def test_profiles_and_cautions(spark, ops):
    assert [r["weight"] for r in grammars.weights_in_order(ops.where("cluster_id = '3' and arity = 1")).collect()] == sorted((r["weight"] for r in ops.where("cluster_id = '3' and arity = 1").collect()), reverse=True)
    shown = grammars.profile(grammars.builtin(spark), ops).collect()
    assert len(shown) == 13 and all(r["name"] and r["operators_text"] and r["functions_text"] for r in shown)
    rows = spark.createDataFrame([("0", "0", "Thermal", ["Thermal"]), ("1", "0", "Optics", ["Thermal"]), ("1", "0", "Optics", []), (None, "0", None, ["Thermal"])], "cluster string, cluster_id string, subfield string, preferred array<string>")
    assert [(r["caution"], r["agrees"]) for r in similarity.with_caution(rows).collect()] == [(False, True), (True, False), (False, False), (False, False)]


def test_best_matches_without_all_pairs(spark):
    """The same rows as from every pair, with fewer pairs scored."""
    import random

    from pyspark.sql.window import Window

    rng = random.Random(31)
    part = lambda: rng.choice(["a*x", "k/sqrt(d)", "exp(-x/t)", "log(q)", "b*sin(w*t)", "x^2", "c", "x/y", "sqrt(x)*exp(y)", "tan(z)"])
    formula = lambda: " + ".join(part() for _ in range(rng.choice([1, 1, 2, 3])))
    found = spark.createDataFrame([(i, formula(), str(i % 3), ["F1"] if i % 2 else []) for i in range(40)], "equation_id int, f string, cluster_id string, preferred array<string>")
    found = similarity.with_signature(found, "f").withColumn("core", F.when(F.col("equation_id") % 4 == 0, text.signature(F.lit("k/sqrt(d) + x^2")))).cache()
    shelf = spark.createDataFrame([(i, formula(), str(i % 3), f"F{i % 4}", rng.random()) for i in range(120)], "position int, f string, cluster string, subfield string, quality double")
    shelf = shelf.withColumn("lib_sig", text.signature(F.col("f"))).drop("f").cache()
    for same, preferred in ((False, True), (True, False)):
        pairs = found.join(shelf, F.col("cluster_id") == F.col("cluster")) if same else found.crossJoin(shelf)
        score = F.greatest(similarity.similarity(F.col("sig"), F.col("lib_sig")), F.when(F.col("core").isNotNull(), similarity.similarity(F.col("core"), F.col("lib_sig")))) * (0.5 + 0.5 * F.col("quality"))
        if preferred:
            score = score * F.when((F.size("preferred") > 0) & ~F.array_contains("preferred", F.col("subfield")), 0.85).otherwise(1.0)
        place = F.row_number().over(Window.partitionBy("equation_id").orderBy(F.desc("score"), "position"))
        want = {(r[0], r[1], r[2]) for r in pairs.withColumn("score", score).withColumn("place", place).where("place <= 3").select("equation_id", "place", "position").collect()}
        got = {(r[0], r[1], r[2]) for r in similarity.top_similar(found, shelf, 3, same_cluster=same, preferred=preferred).select("equation_id", "place", "position").collect()}
        assert got == want
    alone = found.drop("core").withColumn("fp", similarity.profile(F.col("sig")))
    apart = shelf.withColumn("lp", similarity.profile(F.col("lib_sig")))
    scored = alone.join(similarity.worth_scoring(alone, apart, 3, False, False), "fp").join(apart, "lp").count()
    assert 0 < scored < 40 * 120 / 2


def test_labels_of_one_name(spark):
    """One label on most rows: the numbers are those of a plain count, in ranges that each hold a small share."""
    rows = spark.createDataFrame([(i * 7 % 1000 if i % 50 else None, i, None if i % 97 == 0 else "hot" if i % 3 else f"n{i % 5}") for i in range(1000)], "position int, tie int, base string")
    got = {(r["tie"], r["label"]) for r in catalog.labelled(rows, F.col("base"), ["position", "tie"], pieces=16).collect()}
    seen, want = {}, set()
    for r in sorted(rows.collect(), key=lambda r: (r["position"] is not None, r["position"] or 0, r["tie"])):
        seen[r["base"]] = seen.get(r["base"], 0) + 1
        want.add((r["tie"], r["base"] if seen[r["base"]] == 1 or r["base"] is None else f"{r['base']} #{seen[r['base']]}"))
    assert got == want


@pytest.mark.parametrize("accuracy,most", [(10_000, 100_000), (50, 40), (20, 5)])
def test_quantiles_of_narrowed_brackets(spark, accuracy, most):
    """Exact for any number of values: brackets are cut down until few rows are left to rank."""
    rng = np.random.default_rng(12)
    a, b = rng.normal(size=3000), np.where(rng.random(3000) < 0.6, 7.0, rng.integers(0, 2000, 3000))
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b, strict=True)], "a double, b double, c double").repartition(5)
    found = {(r["feature"], r["share"]): r["value"] for r in stats.quantiles(df, (0.0, 0.25, 0.5, 0.9, 1.0), accuracy, most).collect()}
    for name, values in (("a", a), ("b", b)):
        for share in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert found[name, share] == pytest.approx(np.quantile(values, share), rel=1e-12), (name, share)
    assert not [k for k in found if k[0] == "c"]
