"""The analyses a user starts: probes, searches under one grammar, comparisons and their report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, tree
from ..functions.transforms import adjusted_r2, confidence
from ..operators import fit, inner, probe, rank, similarity, stats
from ..operators.features import engineered
from ..sources import grammars as G
from ..sources.dataset import DatasetError, features_of, validated


@dataclass
class Run:
    """Results of a search under one grammar."""

    cluster_id: str
    features: DataFrame
    equations: DataFrame
    matches: DataFrame
    compatibility: DataFrame
    candidates: DataFrame
    influence: DataFrame
    constants: int = 0


def grammar_functions(ops: DataFrame, cluster_id: str) -> set[str]:
    found = {r["op"] for r in ops.where((F.col("cluster_id") == cluster_id) & (F.col("arity") == 1)).collect()}
    if not found:
        known = sorted(r["cluster_id"] for r in ops.select("cluster_id").distinct().collect())
        raise DatasetError(f"no grammar {cluster_id}; there are {', '.join(known) or 'none'}")
    return found


def used_ops(equations: DataFrame, by: list[str]) -> DataFrame:
    """(by, cluster_id, op): operators and functions of each equation's signature."""
    return equations.select(*by, "cluster_id", F.explode(F.concat("sig.operators", "sig.functions")).alias("op"))


def searches(spark: SparkSession, df: DataFrame, target: str, cluster_ids: list[str], ops: DataFrame, library: DataFrame, terms: int = 3, constants: int = 0) -> dict[str, Run]:
    """Under each grammar the features it allows, the best equations they give, and what those resemble.

    The data are read three times, for any number of grammars: for signs,
    means and products of the union of all features. Each grammar is solved
    from its part of those moments. With ``constants`` functions of raw
    columns with fitted constants inside, up to that many in a sum, are
    searched as well, in passes of their own for each grammar. Equations with
    an exponential in an exponential or a power in a power are no candidates.
    """
    rows = validated(df, target)
    functions = {c: grammar_functions(ops, c) for c in cluster_ids}
    wide, plan = engineered(rows, target)
    moments = fit.centred_moments(wide, target, [f.name for f in plan])
    found, scored = [], []
    for c, allowed in functions.items():
        usable = fit.relevant(moments, plan, allowed)
        scored += [(c, plan[i].name, moments.r2(i), i) for i in usable]
        for row in fit.grown(moments, plan, usable, terms):
            drops = fit.expected_importance(moments, plan, row[4], row[5])
            total = sum(drops.values())
            found.append((c, *row, {n: d / total for n, d in drops.items()} if total > 1e-12 else {}))
    equations = spark.createDataFrame(found, f"cluster_id string, {fit.SEARCHED}, shares map<string,double>")
    if constants:
        binary = {r["op"] for r in ops.where("arity = 2").select("op").distinct().collect()}
        for c, allowed in functions.items():
            models, _ = inner.fit_constants(spark, rows, target, features_of(rows, target), allowed | binary, constants)
            own = models.select(F.lit(c).alias("cluster_id"), "complexity", "loss", "r2", "terms", "features", "coefficients", "intercept", "equation", F.lit(None).cast("map<string,double>").alias("shares"))
            equations = equations.unionByName(own)
    sound = equations.where(~F.coalesce(tree.nested(tree.tree(F.col("equation"))), F.lit(False)))
    front = fit.pareto_front(sound, by=["cluster_id"], tie="equation")
    signed = similarity.with_signature(front, "equation", hint="complexity")
    signed = signed.withColumn("equation_id", F.format_string("C%s-%d", "cluster_id", "complexity")).withColumn("key", text.structural_key(F.col("equation")))
    signed = signed.withColumn("shown", text.renamed_constants(F.col("equation"))).withColumn("adjusted_r2", adjusted_r2(F.col("r2"), F.lit(moments.rows), F.col("sig.var_count")))
    # Equations are as many as grammars and columns give, and every part below reads them: they are kept.
    signed = signed.cache()
    used = used_ops(signed, ["equation_id"])
    formulas = spark.createDataFrame([(f.name, f.formula) for f in plan], "feature string, formula string")
    carried = similarity.carried(signed.where("shares is not null"), "equation", formulas, ["equation_id"])
    # Where nothing is known of importance every operator counts whole.
    whole = used.join(signed.where("shares is null").select("equation_id"), "equation_id", "left_semi").select("equation_id", "op", F.lit(1.0).alias("influence"))
    influence = carried.unionByName(whole).cache()
    agreed = similarity.compatibility(used, ops, ["equation_id"], influence)
    detail = similarity.matched_and_missing(used, ops, ["equation_id"])
    matches = similarity.top_similar(signed, library).cache()
    nearest = matches.where("place = 1").select("equation_id", F.col("score").alias("similarity"), F.col("display_name").alias("reference_name"))
    candidates = (
        signed.join(agreed.drop("cluster_id"), "equation_id").join(nearest, "equation_id", "left")
        .select("cluster_id", F.col("shown").alias("equation"), "loss", "complexity", "r2", "compatibility", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("reference_name", F.lit("Unknown")).alias("reference_name"), "key")
    )
    agreement = agreed.join(detail.drop("cluster_id"), "equation_id").withColumn("confidence", confidence(F.col("compatibility") * 100)).cache()
    candidates = candidates.cache()
    features = spark.createDataFrame(scored, "cluster_id string, feature string, r2 double, at int")
    own = lambda frame, c: frame.where(F.col("cluster_id") == c)
    return {
        c: Run(
            c, own(features, c).orderBy(F.desc("r2"), "at").limit(10).select("feature", "r2"), own(signed, c), own(matches, c), own(agreement, c), own(candidates, c),
            influence.join(own(signed, c).select("equation_id"), "equation_id", "left_semi"), constants,
        )
        for c in cluster_ids
    }


def search(spark: SparkSession, df: DataFrame, target: str, cluster_id: str, ops: DataFrame, library: DataFrame, terms: int = 3, constants: int = 0) -> Run:
    """The searches of one grammar."""
    return searches(spark, df, target, [cluster_id], ops, library, terms, constants)[cluster_id]


def evidence(spark: SparkSession, df: DataFrame, target: str, run: Run, ops: DataFrame, library: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the best equation of a run rests on.

    Returns the importance of each of its features, its agreement with the
    grammar counting operators by the importance they carry, and its nearest
    reference equations by itself or by its dominant core.
    """
    best = run.equations.orderBy("loss", "complexity").first()
    rows = validated(df, target)
    wide, plan = engineered(rows, target)
    formula = {f.name: f.formula for f in plan}
    if best["shares"] is None:  # constants inside functions: the text itself predicts, from raw columns
        names, predict = list(dict.fromkeys(best["features"])), fit.predictor(spark, best["equation"])
    else:
        names, weights = best["features"], best["coefficients"]
        predict = lambda c: sum((F.lit(w) * c[n] for n, w in zip(names, weights, strict=True)), F.lit(best["intercept"]))
    importance = stats.permutation_importance(wide.select(target, *names), target, names, predict)
    shares = stats.shares(importance)
    known = spark.createDataFrame([(best["equation_id"], n, formula[n]) for n in names], "equation_id string, feature string, formula string")
    one = run.equations.where(F.col("equation_id") == best["equation_id"])
    carried = similarity.carried(one.drop("shares"), "equation", known.drop("equation_id").join(shares, "feature"), ["equation_id"])
    agreed = similarity.compatibility(used_ops(one, ["equation_id"]), ops, ["equation_id"], carried)
    core = similarity.dominant_core(known.join(shares, "feature"), ["equation_id"])
    return importance, agreed, similarity.top_similar(one.join(core, "equation_id", "left"), library)


def auto_probe(spark: SparkSession, df: DataFrame, target: str, library: DataFrame, grammars: DataFrame | None = None, constants: int = 0) -> tuple[DataFrame, Run]:
    """Fast probe of all grammars, then a search under the winner."""
    grammars = grammars if grammars is not None else G.builtin(spark)
    ops = G.operator_table(grammars)
    scores = probe.fast_probe(validated(df, target), target, grammars, ops)
    best = scores.where("wins").first()
    return scores, search(spark, df, target, best["cluster_id"], ops, library, constants=constants)


def research_probe(spark: SparkSession, df: DataFrame, target: str, library: DataFrame, grammars: DataFrame | None = None, terms: int = 2) -> tuple[DataFrame, dict[str, Run]]:
    """A short search under every grammar, ranked by loss, agreement and complexity."""
    grammars = grammars if grammars is not None else G.builtin(spark)
    ops = G.operator_table(grammars)
    runs = searches(spark, df, target, [r["cluster_id"] for r in grammars.select("cluster_id").orderBy("cluster_id").collect()], ops, library, terms)
    best = None
    for run in runs.values():
        row = run.candidates.orderBy("loss", "complexity").limit(1)
        best = row if best is None else best.unionByName(row)
    return rank.research_scores(best.select("cluster_id", "loss", "complexity", "compatibility", "r2", "equation")), runs


def top_three(probes: DataFrame, runs: dict[str, Run]) -> tuple[DataFrame, DataFrame]:
    """The three best grammars in order, and their candidates merged."""
    chosen = [r["cluster_id"] for r in probes.where("place <= 3").orderBy("place").collect()]
    merged = None
    for c in chosen:
        merged = runs[c].candidates if merged is None else merged.unionByName(runs[c].candidates)
    winners = rank.best_runs(probes.where(F.col("cluster_id").isin(chosen)).drop("place"))
    return winners, rank.merged(merged)


def probe_report(scores: DataFrame) -> str:
    """Scores of a fast or research probe by grammar, with near ties; one row per grammar is fetched."""
    research = "combined" in scores.columns
    rows = sorted(scores.collect(), key=lambda r: (not r["cluster_id"].isdigit(), int(r["cluster_id"]) if r["cluster_id"].isdigit() else 0, r["cluster_id"]))
    known = lambda v, form: "none" if v is None else format(v, form)
    lines = ["Research probe: loss, agreement and complexity" if research else "Fast probe: weighted R² of the grammar's functions"]
    for r in rows:
        if research:
            lines.append(f"  C{r['cluster_id']}: combined {r['combined']:.4f}, loss {known(r['loss'], '.6f')}, agreement {known(100 * (r['compatibility'] or 0.0), '.1f')}%, complexity {known(r['complexity'], '.1f')}")
        else:
            lines.append(f"  C{r['cluster_id']}: score {r['score']:.4f}")
    tied = [r["cluster_id"] for r in rows if r["near_tie" if research else "tied"]]
    if len(tied) > 1:
        chosen = next(r["cluster_id"] for r in rows if (r["place"] == 1 if research else r["wins"]))
        lines.append(f"  near ties: {', '.join('C' + c for c in tied)}; C{chosen} is taken")
    return "\n".join(lines)


def comparison_report(winners: DataFrame, merged: DataFrame) -> str:
    """The three compared grammars, then their merged candidates and how many each gave."""
    lines = ["Best grammars by R², agreement, complexity and loss:"]
    for r in winners.orderBy("place").collect():
        r2 = "none" if r["r2"] is None else f"{r['r2']:.5f}"
        lines.append(f"  {r['place']}. C{r['cluster_id']}: R² {r2}, agreement {100 * (r['compatibility'] or 0.0):.1f}%, complexity {r['complexity']}")
    rows = merged.orderBy("place").collect()  # at most ten
    lines.append("Candidates of all of them:" if rows else "No candidates.")
    for r in rows:
        lines.append(f"  {r['place']}. C{r['cluster_id']}: {r['equation']}; loss {r['loss']:.6f}, agreement {100 * (r['compatibility'] or 0.0):.1f}%, likeness {100 * r['similarity']:.1f}% to {r['reference_name']}")
    given = {r["cluster_id"]: r["contributed"] for r in rows}
    if given:
        lines.append("  given by " + ", ".join(f"C{c}: {n}" for c, n in sorted(given.items())))
    return "\n".join(lines)


def report(run: Run, equations: int = 5, matches: int = 5) -> str:
    """A text summary of a run; only the few rows it shows are fetched."""
    lines = [f"Grammar C{run.cluster_id}", "Features by R²:"]
    lines += [f"  {i}. {r['feature']}  R² = {r['r2']:.4f}" for i, r in enumerate(run.features.collect(), 1)]
    best = {r["equation_id"]: r for r in similarity.with_caution(run.matches.where("place = 1")).collect()}
    agreed = {r["equation_id"]: r for r in run.compatibility.collect()}
    for i, r in enumerate(run.equations.orderBy("loss", "complexity").limit(equations).collect(), 1):
        match, fits = best.get(r["equation_id"]), agreed.get(r["equation_id"])
        lines += [f"Equation {i}: {r['shown']}", f"  loss {r['loss']:.6f}, R² {r['r2']:.5f}, complexity {r['complexity']}"]
        if match is not None:
            lines.append(f"  nearest: {match['display_name']} ({100 * match['score']:.1f}%), of {'this grammar' if match['agrees'] else 'grammar C' + str(match['cluster'])}, {match['subfield'] or 'no subfield'}{'; another field than preferred' if match['caution'] else ''}")
            if i == 1:
                lines.append("  likeness of its parts: " + ", ".join(f"{p['part']} {p['value']:.2f}" for p in similarity.breakdown(run.matches.where((F.col("equation_id") == r["equation_id"]) & (F.col("place") == 1)), "sig", "lib_sig", ["equation_id"]).orderBy("place").collect()))
        carried = sorted(run.influence.where(F.col("equation_id") == r["equation_id"]).collect(), key=lambda x: (-x["influence"], x["op"])) if i == 1 else []
        if carried:
            lines.append("  carried by: " + ", ".join(f"{x['op']} {100 * x['influence']:.0f}%" for x in carried))
        if fits is not None:
            lines.append(f"  grammar agreement: {100 * fits['compatibility']:.1f}% ({fits['confidence']}), uses {', '.join(fits['matched_functions'] + fits['matched_operators']) or 'none'}, missing {', '.join(fits['missing_functions'] + fits['missing_operators']) or 'none'}")
    return "\n".join(lines)
