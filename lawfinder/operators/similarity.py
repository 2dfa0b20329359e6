"""Similarity of equation signatures and agreement with grammars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, tree

# Weights of the parts of similarity.
WEIGHTS = {"term_shapes": 0.35, "functions": 0.15, "operators": 0.10, "exponents": 0.15, "var_names": 0.15, "complexity": 0.05, "var_count": 0.05}
OTHER_FIELD = 0.85


def jaccard(a: Column, b: Column) -> Column:
    both, one = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(one == 0, 1.0).otherwise(both / F.greatest(one, F.lit(1)))


def closeness(a: Column, b: Column, scale: float) -> Column:
    return F.coalesce(F.exp(-F.abs(a - b) / scale), F.lit(0.5))


def multiset(a: Column, b: Column) -> Column:
    """Twice the shared count over the sum of counts."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0), lambda s, x: s + x)
    shared = F.aggregate(F.array_intersect(F.map_keys(a), F.map_keys(b)), F.lit(0), lambda s, k: s + F.least(a[k], b[k]))
    every = total(a) + total(b)
    return F.when(every == 0, 1.0).otherwise(2.0 * shared / F.greatest(every, F.lit(1)))


def parts(a: Column, b: Column) -> dict[str, Column]:
    return {
        "term_shapes": multiset(a["term_shapes"], b["term_shapes"]), "functions": jaccard(a["functions"], b["functions"]),
        "operators": jaccard(a["operators"], b["operators"]), "exponents": jaccard(a["exponents"], b["exponents"]),
        "var_names": jaccard(a["var_names"], b["var_names"]), "complexity": closeness(a["complexity"], b["complexity"], 8.0),
        "var_count": closeness(a["var_count"], b["var_count"], 3.0),
    }


def similarity(a: Column, b: Column) -> Column:
    return sum((F.lit(WEIGHTS[k]) * c for k, c in parts(a, b).items()), F.lit(0.0))


def breakdown(pairs: DataFrame, a: str, b: str, keep: list[str]) -> DataFrame:
    """One row per part of the similarity of two signature columns, in order."""
    cells = [F.struct(F.lit(i).alias("place"), F.lit(k).alias("part"), c.alias("value")) for i, (k, c) in enumerate(parts(F.col(a), F.col(b)).items(), 1)]
    return pairs.select(*keep, F.inline(F.array(*cells)))


#: Parts of the likeness that a profile decides; the rest can add this much at most.
IN_PROFILE = ("term_shapes", "functions", "operators", "exponents", "var_count")
OPEN = sum(w for k, w in WEIGHTS.items() if k not in IN_PROFILE)


def profile(sig: Column) -> Column:
    """A signature without its names and size, as text; many equations share one."""
    return F.to_json(F.struct(sig["functions"].alias("f"), sig["operators"].alias("o"), F.array_sort(F.map_entries(sig["term_shapes"])).alias("s"), sig["exponents"].alias("e"), sig["var_count"].alias("n")))


def profile_likeness(a: Column, b: Column) -> Column:
    known = parts(a, b)
    return sum((WEIGHTS[k] * known[k] for k in IN_PROFILE), F.lit(0.0))


def worth_scoring(found: DataFrame, library: DataFrame, k: int, same_cluster: bool, preferred: bool) -> DataFrame:
    """Pairs of profiles (fp, lp) among which the ``k`` best library rows of every found equation lie.

    Only distinct profiles meet. Of each pair the parts that profiles
    decide bound the score from below, and with all that the others can add
    from above. Library profiles whose upper bound is under the lower bound
    that ``k`` rows reach are left out; which rows are best stays the same.
    """
    mine = found.groupBy("fp").agg(F.first("sig").alias("sig"), *([F.first("core").alias("core")] if "core" in found.columns else []), *([F.first("cluster_id").alias("cluster_id")] if same_cluster else []))
    theirs = library.groupBy("lp").agg(F.first("lib_sig").alias("lib_sig"), F.first("cluster").alias("cluster"), F.count(F.lit(1)).alias("n"), F.min("quality").alias("worst"), F.max("quality").alias("best"))
    pairs = mine.join(theirs, F.col("cluster_id") == F.col("cluster")) if same_cluster else mine.crossJoin(theirs)
    near = profile_likeness(F.col("sig"), F.col("lib_sig"))
    if "core" in found.columns:
        near = F.greatest(near, F.when(F.col("core").isNotNull(), profile_likeness(F.col("core"), F.col("lib_sig"))))
    near = F.coalesce(near, F.lit(0.0))
    low = near * (0.5 + 0.5 * F.coalesce("worst", F.lit(0.0))) * (OTHER_FIELD if preferred else 1.0)
    high = (near + OPEN) * (0.5 + 0.5 * F.coalesce("best", F.lit(1.0)))
    upto = F.sum("n").over(Window.partitionBy("fp").orderBy(F.desc("low"), "lp").rowsBetween(Window.unboundedPreceding, 0))
    ranked = pairs.select("fp", "lp", "n", low.alias("low"), high.alias("high")).withColumn("upto", upto)
    reached = F.max(F.when(F.col("upto") >= k, F.col("low"))).over(Window.partitionBy("fp"))
    return ranked.withColumn("reached", reached).where("reached is null or high >= reached - 1e-9").select("fp", "lp")


def top_similar(found: DataFrame, library: DataFrame, k: int = 5, by: list[str] | None = None, same_cluster: bool = False, preferred: bool = False) -> DataFrame:
    """The ``k`` most similar library rows of each found equation.

    ``found`` has the columns ``by``, ``sig`` and, as the case may be, ``core``
    (signature or null), ``cluster_id`` and ``preferred`` (subfields).
    ``library`` has ``position``, ``lib_sig``, ``quality``, ``cluster`` and
    ``subfield``. Only pairs of profiles that bounds do not rule out are
    scored, and the best ``k`` are kept while pairs stream by.
    """
    by = by or ["equation_id"]
    whose = [profile(F.col("sig")), *([F.coalesce(profile(F.col("core")), F.lit(""))] if "core" in found.columns else []), *([F.coalesce("cluster_id", F.lit(""))] if same_cluster else [])]
    found = found.withColumn("fp", F.concat_ws("|", *whose))
    library = library.withColumn("lp", F.concat_ws("|", profile(F.col("lib_sig")), *([F.coalesce("cluster", F.lit(""))] if same_cluster else [])))
    pairs = found.join(worth_scoring(found, library, k, same_cluster, preferred), "fp").join(library, "lp").drop("fp", "lp")
    score = similarity(F.col("sig"), F.col("lib_sig"))
    if "core" in found.columns:
        score = F.greatest(score, F.when(F.col("core").isNotNull(), similarity(F.col("core"), F.col("lib_sig"))))
    score = score * (0.5 + 0.5 * F.col("quality"))
    if preferred:
        score = score * F.when((F.size("preferred") > 0) & ~F.array_contains("preferred", F.col("subfield")), OTHER_FIELD).otherwise(1.0)
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "position")
    return pairs.withColumn("score", score).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def with_caution(matches: DataFrame) -> DataFrame:
    """Matches with ``caution`` where subfields are preferred and the match is of another one, and ``agrees`` where it is of the chosen grammar."""
    other = ~F.array_contains("preferred", F.col("subfield")) if "preferred" in matches.columns else F.lit(False)
    some = F.size("preferred") > 0 if "preferred" in matches.columns else F.lit(False)
    return matches.withColumn("caution", F.coalesce(some & other, F.lit(False))).withColumn("agrees", F.coalesce(F.col("cluster") == F.col("cluster_id"), F.lit(False)))


def compatibility(used: DataFrame, ops: DataFrame, by: list[str], influence: DataFrame | None = None) -> DataFrame:
    """Share of a grammar's weight that an equation's operators and functions cover.

    ``used`` has ``by``, cluster_id and op; ``influence`` may give each (by,
    op) an evidence between 0 and 1. Without that table all evidence is 1.
    """
    total = ops.groupBy("cluster_id").agg(F.sum("weight").alias("total"))
    hits = used.dropDuplicates([*by, "cluster_id", "op"]).join(ops.select("cluster_id", "op", "weight"), ["cluster_id", "op"], "left")
    if influence is not None:
        hits = hits.join(influence.select(*by, "op", "influence"), [*by, "op"], "left")
        evidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("influence", F.lit(0.0))))
    else:
        evidence = F.lit(1.0)
    mass = hits.groupBy(*by, "cluster_id").agg(F.coalesce(F.sum(F.col("weight") * evidence), F.lit(0.0)).alias("mass"))
    return mass.join(total, "cluster_id").select(*by, "cluster_id", F.when(F.col("total") > 0, F.least(F.lit(1.0), F.col("mass") / F.col("total"))).otherwise(0.0).alias("compatibility"))


def matched_and_missing(used: DataFrame, ops: DataFrame, by: list[str]) -> DataFrame:
    """For each equation the grammar's functions and operators that it has and lacks."""
    own = used.groupBy(*by, "cluster_id").agg(F.collect_set("op").alias("own"))
    known = ops.groupBy("cluster_id").agg(
        F.collect_set(F.when(F.col("arity") == 1, F.col("op"))).alias("fns"), F.collect_set(F.when(F.col("arity") == 2, F.col("op"))).alias("bins")
    )
    sort = F.array_sort
    return own.join(known, "cluster_id").select(
        *by, "cluster_id", sort(F.array_intersect("fns", "own")).alias("matched_functions"), sort(F.array_except("fns", "own")).alias("missing_functions"),
        sort(F.array_intersect("bins", "own")).alias("matched_operators"), sort(F.array_except("bins", "own")).alias("missing_operators"),
    )


def agreement(equations: DataFrame, ops: DataFrame, keep: list[str]) -> DataFrame:
    """Compatibility of each equation's array ``ops`` with every grammar, and what of it the equation has and lacks, with no row per operator."""
    listed = lambda arity: F.array_sort(F.collect_set(F.when(F.col("arity") == arity, F.col("op"))))
    # A row per grammar.
    known = ops.groupBy("cluster_id").agg(F.sum("weight").alias("total"), F.map_from_entries(F.collect_list(F.struct("op", "weight"))).alias("weights"), listed(1).alias("fns"), listed(2).alias("bins"))
    mass = F.aggregate(F.array_distinct("ops"), F.lit(0.0), lambda a, op: a + F.coalesce(F.try_element_at("weights", op), F.lit(0.0)))
    return equations.crossJoin(F.broadcast(known)).select(
        *keep, "cluster_id", F.when(F.col("total") > 0, F.least(F.lit(1.0), mass / F.col("total"))).otherwise(0.0).alias("compatibility"),
        F.array_intersect("fns", "ops").alias("matched_functions"), F.array_except("fns", "ops").alias("missing_functions"),
        F.array_intersect("bins", "ops").alias("matched_operators"), F.array_except("bins", "ops").alias("missing_operators"),
    )


def spent(equations: DataFrame, costs: DataFrame, keep: list[str]) -> DataFrame:
    """What the array ``ops`` of each equation costs in each grammar that has some of them, and how many it has."""
    known = costs.groupBy("cluster_id").agg(F.map_from_entries(F.collect_list(F.struct("op", "cost"))).alias("costs"))  # a row per grammar
    each = F.array_compact(F.transform("ops", lambda op: F.try_element_at("costs", op).cast("long")))
    found = equations.crossJoin(F.broadcast(known)).withColumn("each", each)
    return found.select(*keep, "cluster_id", F.aggregate("each", F.lit(0).cast("long"), lambda a, c: a + c).alias("cost"), F.size("each").cast("long").alias("n_ops")).where("n_ops > 0")


def influence(uses: DataFrame, shares: DataFrame, equation_ops: DataFrame, by: list[str]) -> DataFrame:
    """How much of the prediction each operator carries.

    ``uses`` has ``by`` and the features in each equation with the operators
    of their formulas (feature, ops); ``shares`` each feature's share of the
    importance; ``equation_ops`` the equation's own binary operators, which
    carry at least the mass of all features in use.
    """
    held = uses.join(shares, "feature")
    per = held.select(*by, "share", F.explode("ops").alias("op")).groupBy(*by, "op").agg(F.sum("share").alias("mass"))
    active = held.groupBy(*by).agg(F.sum("share").alias("mass"))
    joint = equation_ops.join(active, by).select(*by, "op", "mass")
    return per.unionByName(joint).groupBy(*by, "op").agg(F.least(F.lit(1.0), F.max("mass")).alias("influence"))


def carried(equations: DataFrame, formula: str, features: DataFrame, by: list[str]) -> DataFrame:
    """(by, op, influence): how much of the importance each operator and function of an equation carries, read off its tree.

    ``features`` has feature, formula and share, a row per feature of a plan;
    where shares differ by equation, ``equations`` has them as a map ``shares``.
    A feature is used where its formula is a subtree, so ``d`` is not found in
    ``sqrtd``; its share goes to the operators and functions of its formula. A
    function also gets the share of each feature with a name in its argument,
    used or not, and each feature counts once per function. Binary operators
    carry at least what all used features carry. Formulas that are none carry nothing.
    """
    binary = lambda t: F.array_distinct(F.filter(t, lambda x: x.isin(*tree.BINARY)))
    spoken = lambda fs: F.array_distinct(F.transform(fs, lambda x: F.when(x == "log10", "log").otherwise(x)))
    apart = "shares" in equations.columns
    known_shares = features.withColumn("share", F.lit(1.0)) if apart else features
    own = known_shares.withColumn("t", tree.tree(F.col("formula"))).where("t is not null and share > 0").select(
        F.struct("feature", "share", "t", F.array_union(binary(F.col("t")), spoken(F.filter("t", tree.is_function))).alias("ops"), tree.names(F.col("t")).alias("names")).alias("f")
    )
    plan = own.agg(F.array_sort(F.collect_list("f")).alias("fs"))  # one row: the features of a plan, as many as its columns give
    known = equations.select(*by, tree.tree(F.col(formula)).alias("t"), *(["shares"] if apart else [])).where("t is not null").join(F.broadcast(plan))
    if apart:
        share = lambda f: F.coalesce(F.try_element_at("shares", f["feature"]), F.lit(0.0))
        mine = F.transform("fs", lambda f: F.struct(f["feature"].alias("feature"), share(f).alias("share"), f["t"].alias("t"), f["ops"].alias("ops"), f["names"].alias("names")))
        known = known.withColumn("fs", F.filter(mine, lambda f: f["share"] > 0))
    marked = known.withColumn("used", F.filter("fs", lambda f: tree.contains(F.col("t"), f["t"]))).withColumn("args", tree.arguments(F.col("t")))
    by_feature = marked.select(*by, F.explode("used").alias("f")).select(*by, F.explode("f.ops").alias("op"), "f.feature", "f.share")
    spread = marked.select(*by, "fs", F.explode("args").alias("a")).select(*by, F.explode(F.filter("fs", lambda f: F.arrays_overlap(f["names"], F.col("a.names")))).alias("f"), spoken(F.array("a.function"))[0].alias("op"))
    once = by_feature.unionByName(spread.select(*by, "op", "f.feature", "f.share")).dropDuplicates([*by, "op", "feature"])
    active = F.aggregate("used", F.lit(0.0), lambda a, f: a + f["share"])
    joint = marked.select(*by, F.explode(binary(F.col("t"))).alias("op"), active.alias("mass"))
    return once.groupBy(*by, "op").agg(F.sum("share").alias("mass")).unionByName(joint).groupBy(*by, "op").agg(F.least(F.lit(1.0), F.max("mass")).alias("influence"))


def dominant_core(held: DataFrame, by: list[str], least: float = 0.01) -> DataFrame:
    """(by, core): signature of the sum of an equation's formulas that carry at least ``least`` of the importance each; none for fewer than two."""
    formulas = held.where(F.col("share") >= least).groupBy(*by).agg(F.array_sort(F.collect_list("formula")).alias("fs"))
    return formulas.where(F.size("fs") >= 2).select(*by, text.signature(F.array_join("fs", " + ")).alias("core"))


def with_signature(df: DataFrame, formula: str, name: str = "sig", hint: str | None = None, expand: bool = False) -> DataFrame:
    """``df`` with the signature of a formula; with ``expand`` products of sums are multiplied out before terms are counted."""
    return df.withColumn(name, text.signature(F.col(formula), hint=F.col(hint) if hint else None, split=tree.expanded if expand else None))
