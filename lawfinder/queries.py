"""Registered queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text, tree
from .functions.transforms import TRANSFORMS, adjusted_r2, confidence, quality_label
from .operators import catalog, equivalence, features, fit, inner, once, probe, rank, similarity, stats
from .sources import dataset, grammars, library, scratch

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"]
TARGET = "l_extendedprice"
#: A target with a known law, so that relevance filters have something to keep.
LAW = "unit_law"
POSITIVE = ["l_quantity", "l_linenumber"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.complete_numeric(_table(spark, sf_dir, "lineitem").select(*FEATURES, TARGET))


def _law(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    return rows.select(*FEATURES, TARGET, (F.col(TARGET) / F.sqrt("l_quantity")).alias(LAW))


def _rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    # adding 0.0 makes a negative zero positive
    return df.withColumns({n: F.round(n, places) + F.lit(0.0) for n in names})


def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dataset.numeric_profile(_table(spark, sf_dir, "lineitem").select(*FEATURES, TARGET))
    return _rounded(found, "least", "deviation")


def univariate_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.top_features(stats.univariate_r2(_law(spark, sf_dir), LAW), [*FEATURES, TARGET]), "r2")


def transform_r2_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.transform_matrix(_lines(spark, sf_dir), TARGET), "r2")


def fast_probe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = grammars.operator_table(grammars.builtin(spark))
    return _rounded(probe.grammar_scores(stats.transform_matrix(_lines(spark, sf_dir), TARGET), ops), "score")


def fast_probe_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = grammars.builtin(spark)
    found = probe.fast_probe(_law(spark, sf_dir).drop(TARGET), LAW, known, grammars.operator_table(known))
    return _rounded(found.where("wins").select("cluster_id", "score", "equation_count"), "score")


def engineered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, _ = features.engineered(_law(spark, sf_dir).drop(TARGET), LAW)
    long = dataset.long_form(wide, [LAW])
    found = long.groupBy("feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"))
    return _rounded(found, "mean", "least", "most")


def feature_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, plan = features.engineered(_law(spark, sf_dir).drop(TARGET), LAW)
    return _rounded(features.kept(features.feature_scores(wide, LAW), plan), "deviation", "r2")


def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_quantity"), F.col(TARGET), "l_discount")
    return _rounded(stats.robust_scaled(rows, ["l_quantity", TARGET, "l_discount"]), "l_quantity", TARGET, "l_discount")


def inverse_scale_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    known = {r["feature"]: r for r in stats.scale_parameters(rows.select("l_quantity", TARGET)).collect()}
    scaled = (F.col("l_quantity") - known["l_quantity"]["centre"]) / known["l_quantity"]["spread"]
    guess = stats.unscaled(0.7 * scaled, F.lit(known[TARGET]["centre"]), F.lit(known[TARGET]["spread"]))
    found = stats.metrics(rows, F.col(TARGET), guess, ["l_returnflag"])
    return _rounded(found.withColumn("adjusted", adjusted_r2(F.col("r2"), F.col("n"), F.lit(1))), "r2", "rmse", "adjusted", places=5)


def parse_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = text.parse_quality(F.col("text"))
    return _rounded(_table(spark, sf_dir, "documents").select("doc_id", quality.alias("quality"), quality_label(quality).alias("label")), "quality")


def text_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.coalesce(F.col("text"), F.lit(""))
    return _table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(text.operators(s), "").alias("operators"), F.size(text.names(s)).cast("long").alias("var_count"),
        F.array_join(text.variables(s), " ").alias("var_names"),
    )


def search_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", text.search_text(F.concat_ws("_-/ ", "event_type", "props")).alias("normal"))


def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = catalog.searched(_table(spark, sf_dir, "part"), "bra-nd 2", ["p_name", "p_brand", "p_type"])
    return hits.select("p_partkey", "p_name", "p_brand")


def catalog_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.labelled(_table(spark, sf_dir, "part"), F.format_string("[%s]  %s  (%s)", "p_brand", F.lit("Part"), "p_type"), ["p_partkey"]).select("p_partkey", "label")


def category_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.profile(_table(spark, sf_dir, "part"), "p_brand", "p_type", "p_name", "p_partkey")
    return found.select("p_brand", "total", F.array_join("top_categories", "|").alias("top_categories"), F.array_join("samples", "|").alias("samples"))


def token_jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item the three documents with most alike word sets, over shared words only."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+"), lambda w: F.length(w) >= 4))
    items = _table(spark, sf_dir, "benchmark").select("item_id", words(F.col("text")).alias("ws")).select("item_id", F.size("ws").alias("n_item"), F.explode("ws").alias("w"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("ws")).select("doc_id", F.size("ws").alias("n_doc"), F.explode("ws").alias("w"))
    both = docs.join(items, "w").groupBy("item_id", "doc_id", "n_item", "n_doc").agg(F.count(F.lit(1)).alias("shared"))
    scored = both.withColumn("score", F.col("shared") / (F.col("n_item") + F.col("n_doc") - F.col("shared")))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return _rounded(scored.withColumn("place", place).where("place <= 3").select("item_id", "place", "doc_id", "score"), "score")


def _law_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[features.Feature]]:
    return features.engineered(_law(spark, sf_dir), LAW)


def one_term_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, plan = _law_features(spark, sf_dir)
    fits = fit.one_term_fits(wide, LAW, plan)
    return _rounded(fits.select("feature", "slope", "intercept", "r2", F.col("complexity").cast("long").alias("complexity")), "slope", "intercept", "r2", places=5)


PAIRED = [TARGET, "inv_sqrt_l_quantity", "log_l_quantity", "l_discount"]


def two_term_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, _ = _law_features(spark, sf_dir)
    return _rounded(fit.two_term_fits(wide, LAW, PAIRED), "coef_a", "coef_b", "intercept", "r2", places=4)


def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, plan = _law_features(spark, sf_dir)
    narrow = [f for f in plan if TARGET not in f.inputs]
    front = fit.pareto_front(fit.one_term_fits(wide.select(LAW, *[f.name for f in narrow]), LAW, narrow))
    return _rounded(front.select("feature", F.col("complexity").cast("long").alias("complexity"), "r2", "score"), "r2", "score", places=5)


def _probes_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each return flag and grammar the best transform it allows: loss, complexity and agreement."""
    rows = _table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col(TARGET) / F.sqrt("l_quantity")).alias("y"))
    cells = F.array(*[F.struct(F.lit(op).alias("op"), stats.transform(op, F.col("x")).alias("v")) for op in ("log", "log10", "sqrt", "sin", "cos", "tan")])
    fits = rows.select("l_returnflag", "y", F.inline(cells)).groupBy("l_returnflag", "op").agg(((1 - F.regr_r2("y", "v")) * F.var_pop("y")).alias("loss"))
    known = grammars.operator_table(grammars.builtin(spark)).where("arity = 1")
    joined = fits.join(known, "op")
    order = Window.partitionBy("l_returnflag", "cluster_id").orderBy(F.round("loss", 4), "op")
    best = joined.withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return best.select("l_returnflag", "cluster_id", "op", "loss", (F.length("op") + 0.0).alias("complexity"), F.col("weight").alias("compatibility"))


def research_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank.research_scores(_probes_by_flag(spark, sf_dir), ["l_returnflag"])
    return _rounded(found.select("l_returnflag", "cluster_id", "op", "combined", "near_tie"), "combined")


def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _probes_by_flag(spark, sf_dir).withColumn("loss", F.round("loss", 3)).withColumn("key", F.concat_ws(":", "l_returnflag", "op")).withColumn("similarity", F.lit(0.0))
    top = rank.merged(found)
    return _rounded(top.select("place", "key", "cluster_id", "loss", "compatibility", F.col("contributed").cast("long").alias("contributed")), "loss", "compatibility", places=3)


def top3_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _probes_by_flag(spark, sf_dir).where("l_returnflag = 'A'")
    runs = one.withColumn("r2", -F.round(F.col("loss"), 2)).withColumn("loss", F.round("loss", 2))
    best = rank.best_runs(runs).where("place <= 3")
    return _rounded(best.select("place", "cluster_id", "op", "loss"), "loss", places=2)


def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance by two permutations, in orders of hashed keys that SQL can repeat."""
    rows = _table(spark, sf_dir, "lineitem")
    keys = [F.md5(F.concat_ws("|", F.lit(seed), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")) for seed in (0, 1, 2)]
    found = stats.permutation_importance(rows, TARGET, ["l_quantity", "l_discount"], lambda c: 1500.0 * c["l_quantity"] - 3000.0 * c["l_discount"], keys)
    return _rounded(found, "importance", "deviation", places=5)


def importance_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of R² among relevant features, in place of shuffled importances that SQL cannot repeat."""
    r2 = stats.univariate_r2(_law(spark, sf_dir), LAW).select("feature", F.col("r2").alias("importance"))
    return _rounded(stats.shares(r2), "share")


def _uses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "l_quantity", ["/", "sqrt"]), (1, TARGET, ["/", "sqrt"]), (2, "l_quantity", ["log"]), (2, "l_tax", ["*"])], "equation_id int, feature string, ops array<string>")


def operator_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    r2 = stats.univariate_r2(_law(spark, sf_dir), LAW).select("feature", F.col("r2").alias("importance"))
    uses = _uses(spark)
    binary = spark.createDataFrame([(1, "/"), (2, "+")], "equation_id int, op string")
    return _rounded(similarity.influence(uses, stats.shares(r2), binary, ["equation_id"]), "influence")


def _fit_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, plan = _law_features(spark, sf_dir)
    fits = fit.one_term_fits(wide, LAW, plan)
    return similarity.with_signature(fits, "equation", hint="complexity").withColumn("equation_id", F.col("feature"))


def grammar_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of every fitted formula with every grammar, with what it lacks."""
    ops = grammars.operator_table(grammars.builtin(spark))
    used = _fit_signatures(spark, sf_dir).select("equation_id", F.explode(F.concat("sig.operators", "sig.functions")).alias("op"))
    every = used.join(ops.select("cluster_id").distinct(), F.lit(True))
    agreed = similarity.compatibility(every, ops, ["equation_id"])
    detail = similarity.matched_and_missing(every, ops, ["equation_id"])
    found = agreed.join(detail, ["equation_id", "cluster_id"])
    return _rounded(found.select(
        "equation_id", "cluster_id", "compatibility", confidence(F.round(F.col("compatibility") * 100, 6)).alias("confidence"),
        F.array_join("matched_functions", " ").alias("matched_functions"), F.array_join("missing_functions", " ").alias("missing_functions"),
    ), "compatibility")


def library_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three reference equations most like each fitted formula."""
    found = similarity.top_similar(_fit_signatures(spark, sf_dir), library.textbook(spark), k=3)
    return _rounded(found.select("equation_id", "place", "display_name", "cluster", "score"), "score")


def formula_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural key, term shapes and renamed constants of every fitted formula."""
    found = _fit_signatures(spark, sf_dir)
    return found.select("equation_id", text.structural_key(F.col("equation")).alias("key"), F.to_json("sig.term_shapes").alias("shapes"), text.renamed_constants(F.col("equation")).alias("renamed"))


def forward_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, plan = features.selected(_law(spark, sf_dir), LAW)
    found = fit.forward_search(spark, wide, LAW, plan, most_terms=3)
    return _rounded(found.select("complexity", "loss", "r2", "terms", "features", "equation"), "loss", "r2")


# Formulas as they come in texts; # stands for a number of the part.
FORMULAS = (
    r"\sigma_{0} = \sigma + \frac{k_{y}}{\sqrt{d}} + #*x^2", r"y = #.5*x^{3/2} - a \cdot \sin(t_1)", "F = G*m1*m2/r^2 + # - #*k", r"k = A \exp(-E/(R*T)) + #.25^3",
    r"\gamma = \left( 1 - v^2/c^2 \right)^{-1/2}", r"E = E_{0} \; - \; # \times log(Q)/(n*F)", "L = cosh(x)/sinh(x) - 1/x + (a - b)*#", r"x = \vphantom{q} \alpha t + #e^-2",
)


def _formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula for each part, with its size as a number."""
    each = F.element_at(F.array(*map(F.lit, FORMULAS)), (F.col("p_partkey") % len(FORMULAS) + 1).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.replace(each, F.lit("#"), F.col("p_size").cast("string")).alias("formula"))


def _signed(rows: DataFrame) -> DataFrame:
    """The different formulas with their signatures."""
    return once.of_each(rows, ["formula"], sig=text.signature)


def formula_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"normal": text.normalized, "canonical": text.canonical, "key": text.structural_key, "compact": text.compact}
    return once.with_each(_formulas(spark, sf_dir), "formula", **made).select("p_partkey", *made)


def formula_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sig")
    texts = _signed(_formulas(spark, sf_dir)).select(
        "formula", F.array_join(s["operators"], " ").alias("operators"), F.array_join(s["functions"], " ").alias("functions"),
        F.array_join(F.transform(s["exponents"], lambda x: F.round(x * 100).cast("int").cast("string")), " ").alias("exponents"), F.array_join(s["var_names"], " ").alias("var_names"),
        s["var_count"].cast("long").alias("var_count"), s["complexity"].alias("complexity"), F.round(text.parse_quality(s["norm"]), 6).alias("quality"),
    )
    return once.beside(_formulas(spark, sf_dir), texts, ["formula"]).drop("formula")


def formula_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many terms of each shape the formulas have."""
    rows = _formulas(spark, sf_dir)
    return once.beside(rows, _signed(rows), ["formula"]).select("p_partkey", F.explode("sig.term_shapes").alias("shape", "n")).withColumn("n", F.col("n").cast("long"))


def _ops_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators and functions of each part's formula, in order."""
    rows = _formulas(spark, sf_dir)
    used = _signed(rows).select("formula", F.concat("sig.operators", "sig.functions").alias("ops"))
    return once.beside(rows, used, ["formula"]).groupBy("p_partkey").agg(F.array_sort(F.flatten(F.collect_list("ops"))).alias("ops"))


def _by_ops(parts: DataFrame, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What is made of the operators of each part, worked out once for equal ones."""
    each = once.spread(parts.select("ops").distinct(), "ops").where(F.size("ops") > 0)
    return once.beside(parts, scratch.cut(made(each)), ["ops"])


def formula_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of each part's formula with each grammar, and what the formula lacks of it."""
    ops = grammars.operator_table(grammars.builtin(spark))
    texts = lambda each: _rounded(similarity.agreement(each, ops, ["ops"]).select(
        "ops", "cluster_id", "compatibility", confidence(F.round(F.col("compatibility") * 100, 6)).alias("confidence"), F.array_join("matched_functions", " ").alias("matched_functions"),
        F.array_join("missing_functions", " ").alias("missing_functions"), F.array_join("matched_operators", "").alias("matched_operators"), F.array_join("missing_operators", "").alias("missing_operators"),
    ), "compatibility")
    return _by_ops(_ops_of_parts(spark, sf_dir), texts).drop("ops")


def formula_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the operators and functions of each part's formula cost in each grammar that has them."""
    costs = grammars.operator_costs(grammars.operator_table(grammars.builtin(spark)))
    return _by_ops(_ops_of_parts(spark, sf_dir), lambda each: similarity.spent(each, costs, ["ops"])).select("p_partkey", "cluster_id", "cost", "n_ops")


def formula_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the likeness of each part's formula to that of the next part, and the whole."""
    rows = _formulas(spark, sf_dir)
    pairs = rows.join(rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("formula").alias("next")), "p_partkey")
    signed = _signed(rows)
    each = once.beside(pairs.select("formula", "next").distinct(), signed, ["formula"])
    each = once.beside(each, signed.select(F.col("formula").alias("next"), F.col("sig").alias("other")), ["next"])
    scored = once.spread(each, "formula", "next").withColumn("score", similarity.similarity(F.col("sig"), F.col("other")))
    found = _rounded(similarity.breakdown(scored, "sig", "other", ["formula", "next", "score"]), "value", "score")
    return once.beside(pairs, scratch.cut(found), ["formula", "next"]).select("p_partkey", "place", "part", "value", "score")


# Formulas with # for a part's size, their postfix form and shortest text, and whether they are nested too deep; written by hand.
TREES = (
    ("# * (a + b)^2 - c", "# a b + 2 ^ * c -", "#*(a + b)^2 - c", False), ("exp(-x/#) * exp(y)", "x ~ # / exp y exp *", "exp(-x/#)*exp(y)", False), ("exp(a*exp(# x))", "a # x * exp * exp", "exp(a*exp(#*x))", True),
    ("k/sqrt(d) - -#", "k d sqrt / # ~ -", "k/sqrt(d) - -#", False), ("x^y^#", "x y # ^ ^", "x^y^#", True), ("2(u + v) w", "2 u v + * w *", "2*(u + v)*w", False), ("log x^2 + #", "x 2 ^ log # +", "log(x^2) + #", False), ("a - (b - #)) + 1", None, None, None),
)
# Formulas to multiply out, with # for the size and @ for the key modulo 7, plus 2.
PRODUCTS = ("#*(x + @)*(y + 2)", "(a + b)^2/#", "exp(-(u + v)*#) - #*(1 - w)", "(p + q)*(p - q) - p^2")
# Formulas of which the first three are one function, and the last two.
SAME = ("(x + #)^2", "x^2 + 2*#*x + #^2", "#^2 + x*(x + 2*#)", "x^2 + 2*#*x + #^2 + 1", "exp(#*x)*exp(y)", "exp(#*x + y)")


def _of_parts(spark: SparkSession, sf_dir: str, forms: tuple[str, ...]) -> DataFrame:
    each = F.element_at(F.array(*map(F.lit, forms)), (F.col("p_partkey") % len(forms) + 1).cast("int"))
    sized = F.replace(each, F.lit("#"), F.col("p_size").cast("string"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.replace(sized, F.lit("@"), (F.col("p_partkey") % 7 + 2).cast("string")).alias("formula"))


def formula_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's formula as a tree, printed again, and whether it is nested too deep."""
    made = lambda t: F.struct(F.array_join(t, " ").alias("postfix"), tree.printed(t).alias("printed"), tree.nested(t).alias("nested"))
    found = once.with_each(_of_parts(spark, sf_dir, tuple(f[0] for f in TREES)), "formula", t=lambda f: tree.let(tree.parsed(f), made))
    return found.select("p_partkey", "t.*")


def formula_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's product of sums, multiplied out."""
    return once.with_each(_of_parts(spark, sf_dir, PRODUCTS), "formula", expanded=tree.expanded).select("p_partkey", "expanded")


def formula_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part whose formula is the same function as each part's."""
    return equivalence.equivalent(_of_parts(spark, sf_dir, SAME), "formula", "p_partkey").select("p_partkey", "class_key")


def argument_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each operator and function of the fitted formulas carries, with shares of R² as importance."""
    wide, plan = _law_features(spark, sf_dir)
    scores = stats.univariate_r2(wide, LAW).select("feature", F.col("r2").alias("importance"))
    formulas = spark.createDataFrame([(f.name, f.formula) for f in plan], "feature string, formula string")
    equations = fit.one_term_fits(wide, LAW, plan).select(F.col("feature").alias("equation_id"), "equation")
    return _rounded(similarity.carried(equations, "equation", formulas.join(stats.shares(scores), "feature"), ["equation_id"]), "influence")


def grammar_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best line on one and on two of the features that each grammar allows, all grammars from one set of moments."""
    wide, plan = features.engineered(_law(spark, sf_dir).drop(TARGET), LAW)
    moments = fit.centred_moments(wide, LAW, [f.name for f in plan])
    functions: dict[str, set[str]] = {}
    for r in grammars.operator_table(grammars.builtin(spark)).where("arity = 1").collect():  # the 13 grammars
        functions.setdefault(r["cluster_id"], set()).add(r["op"])
    rows = [(c, row[3], "|".join(row[4]), row[0], row[2]) for c, fns in functions.items() for row in fit.small_models(moments, plan, fit.relevant(moments, plan, fns))]
    return _rounded(spark.createDataFrame(rows, "cluster_id string, terms int, features string, complexity int, r2 double"), "r2")


def inner_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decay's constant, found among exponentials, logarithms and inverses of all features."""
    rows = _lines(spark, sf_dir).withColumn("decay", 5 * F.exp(-0.04 * F.col("l_quantity")) + 1).drop(TARGET)
    found, _ = inner.fit_constants(spark, rows, "decay", FEATURES, {"exp", "log", "/"}, most_terms=1)
    best = found.orderBy("loss", "complexity").limit(1)
    return _rounded(best.select(F.col("forms")[0].alias("form"), F.col("features")[0].alias("feature"), F.col("constants")[0].alias("b"), F.col("coefficients")[0].alias("slope"), "intercept", "r2"), "b", "slope", "intercept", "r2", places=5)


#: Parts whose formulas stand as the library of the others.
SHELF = 60


def formula_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three of the first parts whose formulas are most like each part's, with the quality of their text."""
    rows = _formulas(spark, sf_dir)
    signed = _signed(rows)
    first = once.beside(rows.where(F.col("p_partkey") <= SHELF), signed, ["formula"])
    shelf = first.select(F.col("p_partkey").alias("position"), F.col("sig").alias("lib_sig"), text.parse_quality(F.col("sig.norm")).alias("quality"), F.lit("0").alias("cluster"), F.lit("").alias("subfield"))
    found = _rounded(similarity.top_similar(signed, shelf, k=3, by=["formula"]), "score").select("formula", "place", "position", "score")
    return once.beside(rows, scratch.cut(found), ["formula"]).select("p_partkey", "place", "position", "score")


GROUPS = ["l_returnflag", "l_linestatus"]


def research_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each flag and status, all grammars by their best function of any feature: research score, near ties, and place by fit alone."""
    rows = _table(spark, sf_dir, "lineitem")
    law = rows.select(*GROUPS, *FEATURES, (F.col(TARGET) / F.sqrt("l_quantity")).alias(LAW))
    probes = probe.grouped_probes(law, LAW, GROUPS, grammars.operator_table(grammars.builtin(spark)))
    ranked = rank.best_runs(probes, GROUPS).withColumnRenamed("place", "run_place")
    found = rank.research_scores(ranked, GROUPS)
    return _rounded(found.select(*GROUPS, "cluster_id", "feature", "op", "r2", "complexity", "combined", "near_tie", "place", "run_place"), "r2", "combined")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        numeric_profile, univariate_r2, transform_r2_matrix, fast_probe_scores, fast_probe_winner, engineered_features, feature_filter, robust_scale, inverse_scale_metrics,
        parse_quality, text_signature, search_words, catalog_search, catalog_labels, category_profile, token_jaccard_topk, one_term_fits, two_term_fits, pareto_front, research_rank,
        merge_candidates, top3_winner, permutation_importance, importance_shares, operator_influence, grammar_agreement, library_matches, formula_shapes, forward_search,
        formula_normal_forms, formula_signatures, formula_terms, formula_agreement, formula_costs, formula_likeness,
        formula_trees, formula_expansion, formula_classes, argument_influence, grammar_winners, inner_constants, formula_matches, research_by_group,
    )
}


# --- SQL ---------------------------------------------------------------------------------------------------------------

_FN = {
    "raw": "x", "log": "ln(abs(x) + 1e-9)", "log10": "log10(abs(x) + 1e-9)", "exp": "exp(greatest(-50.0, least(50.0, x)))", "sqrt": "sqrt(abs(x))", "sin": "sin(x)", "cos": "cos(x)",
    "tan": "tan(x)", "sinh": "sinh(x)", "cosh": "cosh(x)", "tanh": "tanh(x)",
}
_LONG = lambda cols, y, extra="": " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y{extra} FROM src" for c in cols)
_SRC = f"src AS (SELECT *, {TARGET} / sqrt(l_quantity) AS {LAW} FROM lineitem)"
_R2 = "CASE WHEN NOT bool_and(isfinite({x})) OR count(*) < 3 OR stddev_pop(CASE WHEN isfinite({x}) THEN {x} END) < 1e-10 THEN 0.0 ELSE greatest(0.0, coalesce(regr_r2(y, CASE WHEN isfinite({x}) THEN {x} END), 0.0)) END"


def _r2(x: str) -> str:
    return _R2.format(x=x)


def _matrix(y: str, cols: list[str]) -> str:
    cells = " UNION ALL ".join(f"SELECT '{op}' AS op, feature, y, {_FN[op]} AS v FROM long" for op in TRANSFORMS)
    return f"{_SRC}, long AS ({_LONG(cols, y)}), cells AS ({cells}), matrix AS (SELECT op, feature, {_r2('v')} AS r2 FROM cells GROUP BY op, feature)"


def _unary() -> str:
    rows = []
    for cid, _, n, _, _, fns in grammars.GRAMMARS:
        total = sum(1 if c is None else c for c in fns.values())
        rows += [f"('{cid}', '{grammars.FUNCTION_NAMES[k]}', {1 if c is None else c}.0 / {total}.0, {n})" for k, c in fns.items()]
    return f"g(cluster_id, op, w, equation_count) AS (SELECT a, b, CAST(c AS DOUBLE), d FROM (VALUES {', '.join(rows)}) t(a, b, c, d))"


def _scores(y: str, cols: list[str]) -> str:
    return (
        f"WITH {_matrix(y, cols)}, {_unary()}, best AS (SELECT op, max(r2) AS best FROM matrix GROUP BY op), "
        "scores AS (SELECT cluster_id, equation_count, (0.1 * (SELECT best FROM best WHERE op = 'raw') + sum(w * best)) / (0.1 + sum(w)) AS score FROM g JOIN best USING (op) GROUP BY cluster_id, equation_count)"
    )


_ENGINEERED = [f for f in features.planned(FEATURES, set(POSITIVE))]
_ENGINEERED_ALL = [f for f in features.planned([*FEATURES, TARGET], {*POSITIVE, TARGET})]


def _feature_sql(f: features.Feature) -> str:
    a = f"CAST({f.inputs[0]} AS DOUBLE)"
    return {
        "raw": a, "inv_sqrt": f"1 / sqrt({a})", "sqrt": f"sqrt({a})", "log": f"ln({a})",
        "quotient": f"{a} / sqrt(CAST({f.inputs[-1]} AS DOUBLE))",
    }[f.kind]


def _wide(plan: list[features.Feature]) -> str:
    return " UNION ALL ".join(f"SELECT '{f.name}' AS feature, {_feature_sql(f)} AS x, {LAW} AS y, {fit.formula_size(f) + 4} AS complexity FROM src" for f in plan)


_RAW = "(" + ", ".join(f"'{c}'" for c in FEATURES) + ")"
_FLAG_OPS = ("log", "log10", "sqrt", "sin", "cos", "tan")
_FLAG = (
    f"WITH src AS (SELECT l_returnflag, l_quantity AS x, {TARGET} / sqrt(l_quantity) AS y FROM lineitem), {_unary()}, cells AS ("
    + " UNION ALL ".join(f"SELECT l_returnflag, '{op}' AS op, {_FN[op]} AS v, y FROM src" for op in _FLAG_OPS)
    + "), fits AS (SELECT l_returnflag, op, (1 - regr_r2(y, v)) * var_pop(y) AS loss FROM cells GROUP BY ALL), "
    "ranked AS (SELECT l_returnflag, cluster_id, op, loss, CAST(length(op) AS DOUBLE) AS complexity, w AS compatibility, "
    "row_number() OVER (PARTITION BY l_returnflag, cluster_id ORDER BY round(loss, 4), op) AS n FROM fits JOIN g USING (op)), probes AS (SELECT * EXCLUDE n FROM ranked WHERE n = 1)"
)
_UNIT = "CASE WHEN max({c}) OVER w - min({c}) OVER w <= 1e-12 THEN 1.0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"


def _pairs() -> str:
    by = {f.name: f for f in _ENGINEERED_ALL}
    out = []
    for i, a in enumerate(PAIRED):
        for b in PAIRED[i + 1 :]:
            out.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {_feature_sql(by[a])} AS a, {_feature_sql(by[b])} AS b, {LAW} AS y FROM src")
    return " UNION ALL ".join(out)


_WORDS = "list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda w: length(w) >= 4))"
_IDENT = "list_distinct(list_filter(regexp_extract_all(coalesce(text, ''), '[a-zA-Z_][a-zA-Z_0-9]*'), lambda t: NOT list_contains(['exp','log10','log','sqrt','sinh','cosh','tanh','sin','cos','tan'], t)))"

ORACLE_SQL: dict[str, str] = {
    "numeric_profile": f"WITH {_SRC}, long AS ({_LONG([*FEATURES, TARGET], TARGET)}) SELECT feature, count(*) AS n, count(*) FILTER (x IS NULL OR isnan(x)) AS n_missing, round(min(x), 6) + 0.0 AS least, "
    "round(stddev_pop(x), 6) + 0.0 AS deviation, min(x) > 0 AS positive, stddev_pop(x) < 1e-10 AS near_constant FROM long GROUP BY feature",
    "univariate_r2": f"WITH {_SRC}, long AS ({_LONG([*FEATURES, TARGET], LAW)}) SELECT feature, round({_r2('x')}, 6) AS r2 FROM long GROUP BY feature",
    "transform_r2_matrix": f"WITH {_matrix(TARGET, FEATURES)} SELECT op, feature, round(r2, 6) AS r2 FROM matrix",
    "fast_probe_scores": f"{_scores(TARGET, FEATURES)} SELECT cluster_id, round(score, 6) AS score FROM scores",
    "fast_probe_winner": f"{_scores(LAW, FEATURES)} SELECT cluster_id, round(score, 6) AS score, equation_count FROM scores WHERE (SELECT max(score) FROM scores) - score < 1e-6 ORDER BY equation_count, score DESC, cluster_id LIMIT 1",
    "engineered_features": f"WITH {_SRC}, long AS ({_wide(_ENGINEERED)}) SELECT feature, count(x) AS n, round(avg(x), 6) + 0.0 AS mean, round(min(x), 6) + 0.0 AS least, round(max(x), 6) + 0.0 AS most FROM long GROUP BY feature",
    "feature_filter": f"WITH {_SRC}, long AS ({_wide(_ENGINEERED)}), s AS (SELECT feature, stddev_pop(x) AS deviation, {_r2('x')} AS r2 FROM long GROUP BY feature) "
    f"SELECT feature, round(deviation, 6) AS deviation, round(r2, 6) AS r2 FROM s WHERE feature IN {_RAW} OR (deviation >= 1e-10 AND r2 >= 0.05)",
    "robust_scale": "WITH q AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m{i}, CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1.0 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS s{i}" for i, c in enumerate(["l_quantity", TARGET, "l_discount"]))
    + " FROM lineitem) SELECT l_orderkey, l_linenumber AS line, " + ", ".join(f"round(({c} - m{i}) / s{i}, 6) + 0.0 AS {c}" for i, c in enumerate(["l_quantity", TARGET, "l_discount"])) + " FROM lineitem, q",
    "inverse_scale_metrics": f"WITH q AS (SELECT quantile_cont(l_quantity, 0.5) AS mx, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS sx, quantile_cont({TARGET}, 0.5) AS my, quantile_cont({TARGET}, 0.75) - quantile_cont({TARGET}, 0.25) AS sy FROM lineitem), "
    f"p AS (SELECT l_returnflag, {TARGET} AS y, 0.7 * (l_quantity - mx) / sx * sy + my AS p FROM lineitem, q), m AS (SELECT l_returnflag, avg(y) AS m FROM p GROUP BY 1), "
    "s AS (SELECT l_returnflag, count(*) AS n, 1 - sum(pow(y - p, 2)) / sum(pow(y - m, 2)) AS r2, sqrt(sum(pow(y - p, 2)) / count(*)) AS rmse FROM p JOIN m USING (l_returnflag) GROUP BY 1) "
    "SELECT l_returnflag, n, round(r2, 5) AS r2, round(rmse, 5) AS rmse, round(1 - (1 - r2) * (n - 1) / (n - 2), 5) AS adjusted FROM s",
    "parse_quality": r"WITH q AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0.0 ELSE 1 - least(1.0, 4.0 * (length(text) - length(regexp_replace(text, '[\\{}]|[^\x00-\x7F]', '', 'g'))) / length(text)) END AS quality FROM documents) "
    "SELECT doc_id, round(quality, 6) + 0.0 AS quality, CASE WHEN quality >= 0.8 THEN 'clean' WHEN quality >= 0.4 THEN 'partial debris' ELSE 'heavily garbled' END AS label FROM q",
    "text_signature": f"WITH t AS (SELECT doc_id, coalesce(text, '') AS s, {_IDENT} AS names FROM documents) SELECT doc_id, "
    r"concat(CASE WHEN contains(s, '*') THEN '*' END, CASE WHEN contains(s, '+') THEN '+' END, CASE WHEN regexp_matches(s, ' - |^-') THEN '-' END, CASE WHEN contains(s, '/') THEN '/' END, CASE WHEN contains(s, '^') THEN '^' END) AS operators, "
    r"CAST(len(names) AS BIGINT) AS var_count, coalesce(array_to_string(list_sort(list_distinct(list_transform(names, lambda t: lower(CASE WHEN regexp_replace(regexp_extract(t, '^[^_]*'), '[0-9]+$', '') = '' THEN t ELSE regexp_replace(regexp_extract(t, '^[^_]*'), '[0-9]+$', '') END)))), ' '), '') AS var_names FROM t",
    "search_words": r"SELECT event_id, trim(regexp_replace(regexp_replace(lower(concat_ws('_-/ ', event_type, props)), '[-_/]', ' ', 'g'), '\s+', ' ', 'g')) AS normal FROM events",
    "catalog_search": r"WITH h AS (SELECT *, trim(regexp_replace(regexp_replace(lower(concat_ws(' ', p_name, p_brand, p_type)), '[-_/]', ' ', 'g'), '\s+', ' ', 'g')) AS hay FROM part) SELECT p_partkey, p_name, p_brand FROM h WHERE contains(hay, 'bra') AND contains(hay, 'nd') AND contains(hay, '2')",
    "catalog_labels": "WITH b AS (SELECT p_partkey, concat('[', p_brand, ']  Part  (', p_type, ')') AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k FROM b) SELECT p_partkey, CASE WHEN k = 1 THEN base ELSE concat(base, ' #', k) END AS label FROM n",
    "category_profile": "WITH c AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, f, p_type) AS k FROM c), "
    "t AS (SELECT p_brand, sum(n) AS total, string_agg(p_type, '|' ORDER BY k) FILTER (k <= 3) AS top_categories FROM r GROUP BY p_brand), e AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) "
    "SELECT p_brand, CAST(total AS BIGINT) AS total, top_categories, (SELECT string_agg(p_name, '|' ORDER BY k) FROM e WHERE e.p_brand = t.p_brand AND k <= 3) AS samples FROM t",
    "token_jaccard_topk": f"WITH i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark), d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), iw AS (SELECT item_id, len(ws) AS n_item, unnest(ws) AS w FROM i), dw AS (SELECT doc_id, len(ws) AS n_doc, unnest(ws) AS w FROM d), "
    "b AS (SELECT item_id, doc_id, count(*) / CAST(n_item + n_doc - count(*) AS DOUBLE) AS score FROM iw JOIN dw USING (w) GROUP BY item_id, doc_id, n_item, n_doc), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM b) "
    "SELECT item_id, CAST(place AS INTEGER) AS place, doc_id, round(score, 6) AS score FROM r WHERE place <= 3",
    "one_term_fits": f"WITH {_SRC}, long AS ({_wide(_ENGINEERED_ALL)}) SELECT feature, round(regr_slope(y, x), 5) + 0.0 AS slope, round(regr_intercept(y, x), 5) + 0.0 AS intercept, round(regr_r2(y, x), 5) + 0.0 AS r2, CAST(any_value(complexity) AS BIGINT) AS complexity FROM long GROUP BY feature",
    "two_term_fits": f"WITH {_SRC}, long AS ({_pairs()}), c AS (SELECT feature_a, feature_b, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cab, covar_pop(a, y) AS ca, covar_pop(b, y) AS cb, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(y) AS vy FROM long GROUP BY ALL), "
    "s AS (SELECT *, (ca * vb - cb * cab) / (va * vb - cab * cab) AS ka, (cb * va - ca * cab) / (va * vb - cab * cab) AS kb FROM c) SELECT feature_a, feature_b, round(ka, 4) + 0.0 AS coef_a, round(kb, 4) + 0.0 AS coef_b, round(my - ka * ma - kb * mb, 4) + 0.0 AS intercept, round((ka * ca + kb * cb) / vy, 4) + 0.0 AS r2 FROM s",
    "pareto_front": f"WITH {_SRC}, long AS ({_wide(_ENGINEERED)}), f AS (SELECT feature, any_value(complexity) AS complexity, regr_r2(y, x) AS r2, (1 - regr_r2(y, x)) * var_pop(y) AS loss FROM long GROUP BY feature), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY complexity ORDER BY loss, feature) AS k FROM f), m AS (SELECT *, min(loss) OVER (ORDER BY complexity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM b WHERE k = 1), p AS (SELECT * FROM m WHERE low IS NULL OR loss < low) "
    "SELECT feature, CAST(complexity AS BIGINT) AS complexity, round(r2, 5) AS r2, round(coalesce(-(ln(loss) - ln(lag(loss) OVER (ORDER BY complexity))) / (complexity - lag(complexity) OVER (ORDER BY complexity)), 0.0), 5) + 0.0 AS score FROM p",
    "research_rank": f"{_FLAG}, s AS (SELECT l_returnflag, cluster_id, op, 0.6 * {_UNIT.format(c='loss')} + 0.2 * (1 - compatibility) + 0.2 * {_UNIT.format(c='complexity')} AS combined FROM probes WINDOW w AS (PARTITION BY l_returnflag)) "
    "SELECT l_returnflag, cluster_id, op, round(combined, 6) AS combined, combined <= min(combined) OVER (PARTITION BY l_returnflag) + 0.02 AS near_tie FROM s",
    "research_by_group": f"WITH {_SRC}, long AS ({_LONG(FEATURES, LAW, ', l_returnflag, l_linestatus')}), cells AS ("
    + " UNION ALL ".join(f"SELECT l_returnflag, l_linestatus, feature, '{op}' AS op, y, {_FN[op]} AS v FROM long" for op in TRANSFORMS)
    + f"), fits AS (SELECT l_returnflag, l_linestatus, feature, op, {_r2('v')} AS r2, var_pop(y) AS spread FROM cells GROUP BY ALL), {_unary()}, "
    "allowed AS (SELECT cluster_id, op, w FROM g UNION ALL SELECT DISTINCT cluster_id, 'raw', 0.1 FROM g), "
    "scored AS (SELECT l_returnflag, l_linestatus, cluster_id, feature, op, r2, (1 - r2) * spread AS loss, CASE op WHEN 'raw' THEN 5.0 ELSE 6.0 END::DOUBLE AS complexity, w FROM fits JOIN allowed USING (op)), "
    "best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus, cluster_id ORDER BY round_even(r2, 5) DESC, complexity, w DESC, feature, op) = 1), "
    "runs AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY round_even(r2, 5) DESC, w DESC, complexity, loss, cluster_id) AS run_place FROM best), "
    f"s AS (SELECT *, 0.6 * {_UNIT.format(c='loss')} + 0.2 * (1 - w) + 0.2 * {_UNIT.format(c='complexity')} AS combined FROM runs WINDOW w AS (PARTITION BY l_returnflag, l_linestatus)) "
    "SELECT l_returnflag, l_linestatus, cluster_id, feature, op, round(r2, 6) + 0.0 AS r2, complexity, round(combined, 6) + 0.0 AS combined, combined <= min(combined) OVER (PARTITION BY l_returnflag, l_linestatus) + 0.02 AS near_tie, "
    "CAST(row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY combined, cluster_id) AS INTEGER) AS place, CAST(run_place AS INTEGER) AS run_place FROM s",
    "merge_candidates": f"{_FLAG}, c AS (SELECT concat(l_returnflag, ':', op) AS key, cluster_id, round(loss, 3) AS loss, compatibility, complexity FROM probes), u AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY loss, compatibility DESC, complexity, cluster_id) AS n FROM c), "
    "t AS (SELECT *, row_number() OVER (ORDER BY loss, compatibility DESC, complexity, cluster_id, key) AS place FROM u WHERE n = 1), k AS (SELECT * FROM t WHERE place <= 10) "
    "SELECT CAST(place AS INTEGER) AS place, key, cluster_id, round(loss, 3) AS loss, round(compatibility, 3) AS compatibility, count(*) OVER (PARTITION BY cluster_id) AS contributed FROM k",
    "top3_winner": f"{_FLAG}, o AS (SELECT cluster_id, op, round(loss, 2) AS loss, row_number() OVER (ORDER BY round(loss, 2), compatibility DESC, complexity, cluster_id) AS place FROM probes WHERE l_returnflag = 'A') SELECT CAST(place AS INTEGER) AS place, cluster_id, op, loss FROM o WHERE place <= 3",
    "permutation_importance": f"WITH r AS (SELECT l_quantity AS q, l_discount AS d, {TARGET} AS y, "
    + ", ".join(f"row_number() OVER (ORDER BY md5(concat_ws('|', {k}, l_orderkey, l_linenumber, l_partkey, l_suppkey))) AS k{k}" for k in (0, 1, 2))
    + " FROM lineitem), m AS (SELECT avg(y) AS m FROM r), p AS ("
    + " UNION ALL ".join(f"SELECT {k} AS repeat, r.y, r.q, r.d, o.q AS q2, o.d AS d2 FROM r JOIN r o ON r.k0 = o.k{k}" for k in (1, 2))
    + "), t AS (SELECT repeat, sum(pow(y - m, 2)) AS t, sum(pow(y - (1500 * q - 3000 * d), 2)) AS e0, sum(pow(y - (1500 * q2 - 3000 * d), 2)) AS eq, sum(pow(y - (1500 * q - 3000 * d2), 2)) AS ed FROM p, m GROUP BY repeat), "
    "v AS (SELECT 'l_quantity' AS feature, (eq - e0) / t AS x FROM t UNION ALL SELECT 'l_discount', (ed - e0) / t FROM t) SELECT feature, round(avg(x), 5) + 0.0 AS importance, round(stddev_pop(x), 5) + 0.0 AS deviation FROM v GROUP BY feature",
    "importance_shares": f"WITH {_SRC}, long AS ({_LONG([*FEATURES, TARGET], LAW)}), r AS (SELECT feature, {_r2('x')} AS i FROM long GROUP BY feature) SELECT feature, round(i / sum(i) OVER (), 6) AS share FROM r WHERE i > 0",
    "operator_influence": f"WITH {_SRC}, long AS ({_LONG([*FEATURES, TARGET], LAW)}), r AS (SELECT feature, {_r2('x')} AS i FROM long GROUP BY feature), s AS (SELECT feature, i / sum(i) OVER () AS share FROM r WHERE i > 0), "
    f"u(equation_id, feature, op) AS (VALUES (1, 'l_quantity', '/'), (1, 'l_quantity', 'sqrt'), (1, '{TARGET}', '/'), (1, '{TARGET}', 'sqrt'), (2, 'l_quantity', 'log'), (2, 'l_tax', '*')), b(equation_id, op) AS (VALUES (1, '/'), (2, '+')), "
    "a AS (SELECT equation_id, sum(share) AS m FROM (SELECT DISTINCT equation_id, feature FROM u) JOIN s USING (feature) GROUP BY 1), p AS (SELECT equation_id, op, sum(share) AS m FROM u JOIN s USING (feature) GROUP BY 1, 2 UNION ALL SELECT equation_id, op, m FROM b JOIN a USING (equation_id)) "
    "SELECT equation_id, op, round(least(1.0, max(m)), 6) AS influence FROM p GROUP BY 1, 2",
}


def _replaced(column: str, rules) -> str:
    for pattern, new in rules:
        new = new.replace("$", chr(92))
        column = f"regexp_replace({column}, '{pattern}', '{new}', 'g')"
    return column


_NOT_IN_NAME = "(^|[^A-Za-z_0-9])"
_FORMULA = (
    "f AS (SELECT p_partkey, replace(list_extract([" + ", ".join(f"'{x}'" for x in FORMULAS) + f"], CAST(p_partkey % {len(FORMULAS)} + 1 AS INTEGER)), '#', CAST(p_size AS VARCHAR)) AS formula FROM part), "
    f"n AS (SELECT p_partkey, formula, {_replaced('formula', text.NORMAL_RULES)} AS normal FROM f), c AS (SELECT *, {_replaced('normal', text.CANONICAL_RULES)} AS s FROM n)"
)
_SIGNS = (("*", "contains(s, '*')"), ("+", "contains(s, '+')"), ("-", "regexp_matches(s, ' - |^-')"), ("/", "contains(s, '/')"), ("^", "contains(s, '^')"))
_WORDS_OF = [(f, "regexp_matches(s, '" + (r"\blog(10)?\b" if f == "log" else rf"\b{f}\b") + "')") for f in sorted(set(text.FUNCTIONS) - {"log10"})]
_NAMES_OF = "list_distinct(list_filter(regexp_extract_all(s, '[a-zA-Z_][a-zA-Z_0-9]*'), lambda t: NOT list_contains([" + ", ".join(f"'{x}'" for x in text.FUNCTIONS) + "], t)))"
_SHORT = "regexp_replace(regexp_extract(t, '^[^_]*'), '[0-9]+$', '')"
_FRACTION = r"\^\(\s*(-?\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)\s*\)"
_count_of = lambda pattern: f"len(regexp_extract_all(s, '{pattern}'))"
_SIGNED = (
    f"{_FORMULA}, g AS (SELECT p_partkey, s, list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{o}{chr(39)} END' for o, c in _SIGNS)}], lambda x: x IS NOT NULL) AS operators, "
    f"list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{o}{chr(39)} END' for o, c in _WORDS_OF)}], lambda x: x IS NOT NULL) AS functions, "
    f"list_sort(list_distinct(list_transform(list_concat(list_transform(list_zip(regexp_extract_all(s, '{_FRACTION}', 1), regexp_extract_all(s, '{_FRACTION}', 2)), lambda z: CAST(z[1] AS DOUBLE) / CAST(z[2] AS DOUBLE)), "
    r"list_transform(regexp_extract_all(s, '\^\(?\s*(-?\d+\.?\d*)\s*\)?', 1), lambda z: CAST(z AS DOUBLE))), lambda z: CAST(round_even(z * 100, 0) AS INTEGER)))) AS exponents, "
    f"list_sort(list_distinct(list_transform({_NAMES_OF}, lambda t: lower(CASE WHEN {_SHORT} = '' THEN t ELSE {_SHORT} END)))) AS var_names, len({_NAMES_OF}) AS var_count, "
    + _count_of(r"[+\-*/^]") + " + " + " + ".join(_count_of(rf"\b{f}\b") for f in text.FUNCTIONS) + f" + len({_NAMES_OF}) + " + _count_of(r"\d+\.?\d*") + " AS complexity FROM c)"
)
_TERMS = (
    "h AS (SELECT p_partkey, s, unnest(string_split(s, '')) AS x, generate_subscripts(string_split(s, ''), 1) AS i FROM c), "
    "d AS (SELECT *, coalesce(sum(CASE WHEN x IN ('(', '[') THEN 1 WHEN x IN (')', ']') THEN -1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM h), "
    "k AS (SELECT *, sum(CASE WHEN x IN ('+', '-') AND depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i) AS term FROM d), "
    "t AS (SELECT p_partkey, trim(string_agg(x, '' ORDER BY i)) AS t FROM k GROUP BY p_partkey, term), "
    r"m AS (SELECT p_partkey, t, regexp_matches(t, '\bsqrt\b') OR regexp_matches(t, '\^\(?-?0\.5\)?') AS root FROM t WHERE t NOT IN ('', '+', '-')), "
    r"w AS (SELECT p_partkey, concat_ws('_', CASE WHEN root THEN 'sqrt' END, CASE WHEN regexp_matches(t, '\blog\d*\b') THEN 'log' END, CASE WHEN regexp_matches(t, '\bexp\b') THEN 'exp' END, "
    r"CASE WHEN regexp_matches(t, '\b(sin|cos|tan)\b') THEN 'trig' END, CASE WHEN contains(t, '^') AND NOT root THEN 'pow' END, CASE WHEN contains(t, '/') OR regexp_matches(t, '\^\(?-0\.5\)?') THEN 'div' END) AS tags FROM m), "
    "shapes AS (SELECT p_partkey, CASE WHEN tags = '' THEN 'linear' ELSE tags END AS shape, count(*) AS n FROM w GROUP BY ALL)"
)


def _grammar_ops() -> str:
    rows = []
    for cid, _, _, _, ops, _ in grammars.GRAMMARS:
        rows += [f"('{cid}', '{op}', {w})" for op, w in (dict.fromkeys(grammars.ALWAYS, grammars.DEFAULT_WEIGHT) | dict(ops)).items()]
    return f"{_unary()}, ops AS (SELECT cluster_id, op, w, 1 AS arity FROM g UNION ALL SELECT a, b, CAST(c AS DOUBLE), 2 FROM (VALUES {', '.join(rows)}) t(a, b, c))"


_USED = "used AS (SELECT p_partkey, unnest(list_concat(operators, functions)) AS op FROM sg)"
_LACKS = lambda arity, has, sep: f"coalesce(string_agg(o.op, '{sep}' ORDER BY o.op) FILTER (arity = {arity} AND u.op IS {'NOT ' if has else ''}NULL), '')"
_SG = _SIGNED.replace(", g AS (SELECT p_partkey, s, list_filter", ", sg AS (SELECT p_partkey, s, list_filter")
_jac = lambda x: f"CASE WHEN len(list_distinct(list_concat(a.{x}, b.{x}))) = 0 THEN 1.0 ELSE len(list_intersect(a.{x}, b.{x})) / CAST(len(list_distinct(list_concat(a.{x}, b.{x}))) AS DOUBLE) END"

ORACLE_SQL |= {
    "formula_normal_forms": f"WITH {_FORMULA} SELECT p_partkey, normal, s AS canonical, regexp_replace(regexp_replace(s, '{_NOT_IN_NAME}-?[0-9]+(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?', '" + r"\1C" + r"', 'g'), '\s+', '', 'g') AS key, regexp_replace(s, '[\s()]', '', 'g') AS compact FROM c",
    "formula_signatures": f"WITH {_SG} SELECT p_partkey, array_to_string(operators, ' ') AS operators, array_to_string(functions, ' ') AS functions, array_to_string(exponents, ' ') AS exponents, array_to_string(var_names, ' ') AS var_names, "
    + r"CAST(var_count AS BIGINT) AS var_count, CAST(complexity AS DOUBLE) AS complexity, round(CASE WHEN s = '' THEN 0.0 ELSE 1 - least(1.0, 4.0 * (length(s) - length(regexp_replace(s, '[\\{}]|[^\x00-\x7F]', '', 'g'))) / length(s)) END, 6) AS quality FROM sg",
    "formula_terms": f"WITH {_FORMULA}, {_TERMS} SELECT p_partkey, shape, n FROM shapes",
    "formula_agreement": f"WITH {_SG}, {_grammar_ops()}, {_USED} SELECT p_partkey, o.cluster_id, round(least(1.0, sum(CASE WHEN u.op IS NOT NULL THEN w ELSE 0 END) / sum(w)), 6) AS compatibility, "
    "CASE WHEN round(100 * sum(CASE WHEN u.op IS NOT NULL THEN w ELSE 0 END) / sum(w), 6) >= 80 THEN 'High' WHEN round(100 * sum(CASE WHEN u.op IS NOT NULL THEN w ELSE 0 END) / sum(w), 6) >= 50 THEN 'Medium' ELSE 'Low' END AS confidence, "
    f"{_LACKS(1, True, ' ')} AS matched_functions, {_LACKS(1, False, ' ')} AS missing_functions, {_LACKS(2, True, '')} AS matched_operators, {_LACKS(2, False, '')} AS missing_operators "
    "FROM (SELECT p_partkey FROM sg) p CROSS JOIN ops o LEFT JOIN used u USING (p_partkey, op) GROUP BY p_partkey, o.cluster_id",
    "formula_costs": f"WITH {_SG}, {_grammar_ops()}, {_USED}, costs AS (SELECT cluster_id, op, greatest(1, CAST(round_even(1 + 4 * (1 - w / max(w) OVER (PARTITION BY cluster_id)), 0) AS INTEGER)) AS cost FROM ops) "
    "SELECT p_partkey, cluster_id, CAST(sum(cost) AS BIGINT) AS cost, count(*) AS n_ops FROM used JOIN costs USING (op) GROUP BY ALL",
    "formula_likeness": f"WITH {_SG}, {_TERMS}, total AS (SELECT p_partkey, sum(n) AS n FROM shapes GROUP BY 1), common AS (SELECT a.p_partkey, sum(least(a.n, b.n)) AS n FROM shapes a JOIN shapes b ON b.p_partkey = a.p_partkey + 1 AND a.shape = b.shape GROUP BY 1), "
    "v AS (SELECT a.p_partkey, 2.0 * coalesce(common.n, 0) / (x.n + y.n) AS term_shapes, " + ", ".join(f"{_jac(x)} AS {x}" for x in ("functions", "operators", "exponents", "var_names"))
    + ", exp(-abs(a.complexity - b.complexity) / 8.0) AS complexity, exp(-abs(a.var_count - b.var_count) / 3.0) AS var_count FROM sg a JOIN sg b ON b.p_partkey = a.p_partkey + 1 JOIN total x ON x.p_partkey = a.p_partkey JOIN total y ON y.p_partkey = b.p_partkey LEFT JOIN common ON common.p_partkey = a.p_partkey), "
    f"z AS (SELECT *, {' + '.join(f'{w} * {k}' for k, w in similarity.WEIGHTS.items())} AS score FROM v) "
    + " UNION ALL ".join(f"SELECT p_partkey, {i} AS place, '{k}' AS part, round({k}, 6) + 0.0 AS value, round(score, 6) + 0.0 AS score FROM z" for i, k in enumerate(("term_shapes", "functions", "operators", "exponents", "var_names", "complexity", "var_count"), 1)),
}


def _listed(values: tuple, of: str = "p_partkey") -> str:
    """A hand-written value for each part, its size put in."""
    quoted = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"replace(list_extract([{quoted}], CAST({of} % {len(values)} + 1 AS INTEGER)), '#', CAST(p_size AS VARCHAR))"


def _held() -> tuple[str, str, str]:
    """By the kinds of features: (equation, op, feature) that an equation of one feature gives, (equation, feature) it uses, and (equation, binary operator)."""
    names = {f.name for f in _ENGINEERED_ALL}
    ops = {"raw": [], "sqrt": ["sqrt"], "inv_sqrt": ["/", "sqrt"], "log": ["log"], "quotient": ["/", "sqrt"]}
    inside = {
        "raw": lambda f: [f.name], "sqrt": lambda f: [f.inputs[0], f.name], "inv_sqrt": lambda f: [f.inputs[0], f"sqrt_{f.inputs[0]}", f.name], "log": lambda f: [f.inputs[0], f.name],
        "quotient": lambda f: [*f.inputs, f"sqrt_{f.inputs[1]}", f.name],
    }
    by = {f.name: f for f in _ENGINEERED_ALL}
    gives, uses, binary = set(), set(), set()
    for e in _ENGINEERED_ALL:
        for name in names.intersection(inside[e.kind](e)):
            uses.add((e.name, name))
            gives |= {(e.name, op, name) for op in ops[by[name].kind]}
        for fn in {"sqrt", "log"}.intersection(ops[e.kind]):
            gives |= {(e.name, fn, f.name) for f in _ENGINEERED_ALL if e.inputs[-1] in f.inputs}
        binary |= {(e.name, op) for op in ["*", "+", *[o for o in ops[e.kind] if o == "/"]]}
    rows = lambda found: ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in sorted(found))
    return rows(gives), rows(uses), rows(binary)


def _winners() -> str:
    """Best lines on one and two features, from all covariances."""
    plan = _ENGINEERED
    n = len(plan)
    cells = ", ".join(f"covar_pop(f{i}, {'y' if j == n else f'f{j}'}) AS c{i}_{j}" for i in range(n) for j in range(i, n + 1))
    one = " UNION ALL ".join(
        f"SELECT {i} AS i, -1 AS j, '{f.name}' AS features, {fit.formula_size(f) + 4} AS complexity, {str(f.kind == 'log').lower()} AS logs, CASE WHEN c{i}_{i} < 1e-20 THEN 0 ELSE c{i}_{n} * c{i}_{n} / (c{i}_{i} * vy) END AS r2 FROM c" for i, f in enumerate(plan)
    )
    raw = "[" + ", ".join(str(i) for i, f in enumerate(plan) if f.kind == "raw") + "]"
    solved = lambda i, j: f"(c{i}_{n} * c{i}_{n} * c{j}_{j} - 2 * c{i}_{n} * c{j}_{n} * c{i}_{j} + c{j}_{n} * c{j}_{n} * c{i}_{i}) / (vy * (c{i}_{i} * c{j}_{j} - c{i}_{j} * c{i}_{j}))"
    two = " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, '{plan[i].name}|{plan[j].name}' AS features, {fit.formula_size(plan[i]) + fit.formula_size(plan[j]) + 7} AS complexity, {str('log' in (plan[i].kind, plan[j].kind)).lower()} AS logs, {solved(i, j)} AS r2 FROM c" for i in range(n) for j in range(i + 1, n)
    )
    return (
        f"WITH {_SRC}, {_unary()}, w AS (SELECT {LAW} AS y, {', '.join(f'{_feature_sql(f)} AS f{i}' for i, f in enumerate(plan))} FROM src), c AS (SELECT var_pop(y) AS vy, {cells} FROM w), one AS ({one}), "
        f"stays AS (SELECT i FROM one WHERE list_contains({raw}, i) OR r2 >= 0.05), two AS ({two}), every AS (SELECT 1 AS terms, * FROM one WHERE i IN (FROM stays) UNION ALL SELECT 2, * FROM two WHERE i IN (FROM stays) AND j IN (FROM stays)), "
        "logged AS (SELECT cluster_id, bool_or(op IN ('log', 'log10')) AS may FROM g GROUP BY 1), r AS (SELECT cluster_id, terms, features, complexity, r2, row_number() OVER (PARTITION BY cluster_id, terms ORDER BY round(1 - r2, 12), complexity, i, j) AS k FROM every JOIN logged ON may OR NOT logs) "
        "SELECT cluster_id, terms, features, complexity, round(r2, 6) AS r2 FROM r WHERE k = 1"
    )


_GIVES, _USES, _BINARY_OF = _held()
_N, _M = "CAST(p_size AS VARCHAR)", "(p_partkey % 7 + 2)"
ORACLE_SQL |= {
    "formula_trees": f"SELECT p_partkey, {_listed(tuple(f[1] for f in TREES))} AS postfix, {_listed(tuple(f[2] for f in TREES))} AS printed, list_extract([{', '.join('NULL' if f[3] is None else str(f[3]) for f in TREES)}], CAST(p_partkey % {len(TREES)} + 1 AS INTEGER)) AS nested FROM part",
    "formula_expansion": f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(CASE WHEN p_size = 1 THEN '' ELSE {_N} || '*' END, 'x*y + ', 2 * p_size, '*x + ', p_size * {_M}, '*y + ', 2 * p_size * {_M}) "
    f"WHEN 1 THEN CASE WHEN p_size = 1 THEN 'a^2 + 2*a*b + b^2' WHEN p_size = 2 THEN 'a^2/2 + a*b + b^2/2' WHEN p_size % 2 = 0 THEN concat('a^2/', p_size, ' + a*b/', p_size // 2, ' + b^2/', p_size) ELSE concat('a^2/', p_size, ' + 2*a*b/', p_size, ' + b^2/', p_size) END "
    f"WHEN 2 THEN CASE WHEN p_size = 1 THEN 'exp(-u - v) - 1 + w' ELSE concat('exp(-', p_size, '*u - ', p_size, '*v) - ', p_size, ' + ', p_size, '*w') END ELSE '-q^2' END AS expanded FROM part",
    "formula_classes": "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_size, list_extract([0, 0, 0, 1, 2, 2], CAST(p_partkey % 6 + 1 AS INTEGER))) AS class_key FROM part",
    "argument_influence": f"WITH {_SRC}, long AS ({_wide(_ENGINEERED_ALL)}), r AS (SELECT feature, {_r2('x')} AS i FROM long GROUP BY feature), s AS (SELECT feature, i / sum(i) OVER () AS share FROM r WHERE i > 0), "
    f"gives(equation_id, op, feature) AS (VALUES {_GIVES}), uses(equation_id, feature) AS (VALUES {_USES}), b(equation_id, op) AS (VALUES {_BINARY_OF}), "
    "a AS (SELECT equation_id, sum(share) AS m FROM uses JOIN s USING (feature) GROUP BY 1), p AS (SELECT equation_id, op, sum(share) AS m FROM gives JOIN s USING (feature) GROUP BY 1, 2 UNION ALL SELECT equation_id, op, m FROM b JOIN a USING (equation_id)) "
    "SELECT equation_id, op, round(least(1.0, max(m)), 6) AS influence FROM p GROUP BY 1, 2",
    "grammar_winners": _winners(),
    "inner_constants": "WITH s AS (SELECT exp(-0.04 * l_quantity) AS x, 5 * exp(-0.04 * l_quantity) + 1 AS y FROM lineitem) SELECT 'exp' AS form, 'l_quantity' AS feature, -0.04 AS b, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 5) AS intercept, round(regr_r2(y, x), 5) AS r2 FROM s",
}

_QUALITY = r"CASE WHEN s = '' THEN 0.0 ELSE 1 - least(1.0, 4.0 * (length(s) - length(regexp_replace(s, '[\\{}]|[^\x00-\x7F]', '', 'g'))) / length(s)) END"
ORACLE_SQL["formula_matches"] = (
    f"WITH {_SG}, {_TERMS}, total AS (SELECT p_partkey, sum(n) AS n FROM shapes GROUP BY 1), shelf AS (SELECT *, {_QUALITY} AS quality FROM sg WHERE p_partkey <= {SHELF}), "
    f"common AS (SELECT a.p_partkey, b.p_partkey AS position, sum(least(a.n, b.n)) AS n FROM shapes a JOIN shapes b ON b.p_partkey <= {SHELF} AND a.shape = b.shape GROUP BY 1, 2), "
    "v AS (SELECT a.p_partkey, b.p_partkey AS position, b.quality, 2.0 * coalesce(common.n, 0) / (x.n + y.n) AS term_shapes, " + ", ".join(f"{_jac(x)} AS {x}" for x in ("functions", "operators", "exponents", "var_names"))
    + ", exp(-abs(a.complexity - b.complexity) / 8.0) AS complexity, exp(-abs(a.var_count - b.var_count) / 3.0) AS var_count FROM sg a CROSS JOIN shelf b JOIN total x ON x.p_partkey = a.p_partkey JOIN total y ON y.p_partkey = b.p_partkey LEFT JOIN common ON common.p_partkey = a.p_partkey AND common.position = b.p_partkey), "
    f"z AS (SELECT p_partkey, position, ({' + '.join(f'{w} * {k}' for k, w in similarity.WEIGHTS.items())}) * (0.5 + 0.5 * quality) AS score FROM v), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(score, 9) DESC, position) AS place FROM z) SELECT p_partkey, CAST(place AS INTEGER) AS place, position, round(score, 6) AS score FROM r WHERE place <= 3"
)
