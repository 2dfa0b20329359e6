"""Closed-form fits of small models, their Pareto front, and a forward search, all from moments of one reading of the data."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, tree
from ..sources.dataset import long_form
from .features import RELEVANCE, Feature, allowed
from .stats import FLAT

#: Losses below this count as this much in the score of the front.
TINY = 1e-12


def _formula(parts: list[tuple[Column | float, Column | str]], constant: Column | float) -> Column:
    number = lambda c: F.format_string("%.6g", c if isinstance(c, Column) else F.lit(float(c)))
    name = lambda t: t if isinstance(t, Column) else F.lit(t)
    written = [F.concat(number(c), F.lit("*("), name(t), F.lit(")")) for c, t in parts]
    return F.concat_ws(" + ", *written, number(constant))


def one_term_fits(wide: DataFrame, target: str, plan: list[Feature]) -> DataFrame:
    """Line of the target on each feature: slope, intercept, R², mean squared loss, complexity and formula."""
    rows = long_form(wide.withColumnRenamed(target, "__y"), ["__y"])
    y = F.col("__y")
    agg = rows.groupBy("feature").agg(
        F.regr_slope(y, F.col("x")).alias("slope"), F.regr_intercept(y, F.col("x")).alias("intercept"), F.regr_r2(y, F.col("x")).alias("r2"),
        F.var_pop(y).alias("spread"), F.stddev_pop("x").alias("deviation"),
    ).where(F.col("deviation") >= FLAT)
    formula = F.create_map(*[F.lit(x) for f in plan for x in (f.name, f.formula)])[F.col("feature")]
    size = F.create_map(*[F.lit(x) for f in plan for x in (f.name, formula_size(f))])[F.col("feature")]
    return agg.select(
        "feature", "slope", "intercept", "r2", ((1 - F.col("r2")) * F.col("spread")).alias("loss"), (size + 4).alias("complexity"),
        _formula([(F.col("slope"), formula)], F.col("intercept")).alias("equation"),
    )


def formula_size(f: Feature) -> int:
    """Nodes of a feature's expression: names, constants, functions and operators."""
    return {"raw": 1, "sqrt": 2, "log": 2, "inv_sqrt": 4, "quotient": 4}[f.kind]


def two_term_fits(wide: DataFrame, target: str, names: list[str]) -> DataFrame:
    """Planes of the target on each pair of features, solved from covariances of one pass."""
    col = lambda n: F.col(f"`{n}`").cast("double")
    y = col(target)
    aggs = [F.var_pop(y).alias("vy"), F.avg(y).alias("my"), F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(names):
        aggs += [F.var_pop(col(a)).alias(f"v{i}"), F.avg(col(a)).alias(f"m{i}"), F.covar_pop(col(a), y).alias(f"c{i}")]
        aggs += [F.covar_pop(col(a), col(names[j])).alias(f"c{i}_{j}") for j in range(i + 1, len(names))]
    cells = [
        F.struct(F.lit(a).alias("feature_a"), F.lit(names[j]).alias("feature_b"), *[F.col(s).alias(k) for s, k in (
            (f"v{i}", "va"), (f"v{j}", "vb"), (f"c{i}_{j}", "cab"), (f"c{i}", "ca"), (f"c{j}", "cb"), (f"m{i}", "ma"), (f"m{j}", "mb"), ("vy", "vy"), ("my", "my"))])
        for i, a in enumerate(names) for j in range(i + 1, len(names))
    ]
    pairs = wide.agg(*aggs).select(F.inline(F.array(*cells)))
    det = F.col("va") * F.col("vb") - F.col("cab") * F.col("cab")
    solid = pairs.withColumn("det", det).where(F.col("det") > 1e-9 * F.col("va") * F.col("vb"))
    a = (F.col("ca") * F.col("vb") - F.col("cb") * F.col("cab")) / F.col("det")
    b = (F.col("cb") * F.col("va") - F.col("ca") * F.col("cab")) / F.col("det")
    fitted = solid.withColumn("coef_a", a).withColumn("coef_b", b)
    r2 = (F.col("coef_a") * F.col("ca") + F.col("coef_b") * F.col("cb")) / F.col("vy")
    return fitted.select("feature_a", "feature_b", "coef_a", "coef_b", (F.col("my") - F.col("coef_a") * F.col("ma") - F.col("coef_b") * F.col("mb")).alias("intercept"), r2.alias("r2"))


def pareto_front(models: DataFrame, by: list[str] | None = None, tie: str = "feature") -> DataFrame:
    """Models that no simpler one matches, with the score -Δ ln(loss) / Δ complexity."""
    by = by or []
    step = Window.partitionBy(*by, "complexity").orderBy("loss", tie)
    best = models.withColumn("__k", F.row_number().over(step)).where("__k = 1").drop("__k")
    line = Window.partitionBy(*by).orderBy("complexity")
    earlier = F.min("loss").over(line.rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("__low", earlier).where("__low is null or loss < __low").drop("__low")
    log_loss = F.ln(F.greatest(F.col("loss"), F.lit(TINY)))
    gain = -(log_loss - F.lag(log_loss).over(line)) / (F.col("complexity") - F.lag("complexity").over(line))
    return front.withColumn("score", F.coalesce(gain, F.lit(0.0)))


@dataclass(frozen=True)
class Moments:
    """Rows, means, population deviations and correlations of features and, last, the target; their size depends on the columns alone."""

    rows: int
    mean: np.ndarray
    deviation: np.ndarray
    cov: np.ndarray

    @property
    def spread(self) -> float:
        return float(self.deviation[-1] ** 2)

    def r2(self, i: int) -> float:
        """R² of the line on one feature; 0 for a flat one, and 1 for a flat target."""
        if self.deviation[i] < FLAT or self.rows < 3:
            return 0.0
        return float(self.cov[i, -1] ** 2 / (self.cov[i, i] * self.cov[-1, -1])) if self.deviation[-1] >= FLAT else 1.0


def centred_moments(wide: DataFrame, target: str, names: list[str]) -> Moments:
    """The moments of named columns and a target.

    A first pass finds means and deviations, a second the products of the
    scaled values, so that columns far from zero lose nothing.
    """
    cols = [F.col(f"`{n}`").cast("double") for n in [*names, target]]
    first = wide.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    size = len(cols)
    mean = np.array([first[f"m{i}"] if first[f"m{i}"] is not None else 0.0 for i in range(size)])
    deviation = np.array([first[f"d{i}"] if first[f"d{i}"] is not None else 0.0 for i in range(size)])
    scale = np.where(deviation >= FLAT, deviation, 1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), (batch.to_numpy(dtype=float) - mean) / scale])
            total += x.T @ x
        yield pd.DataFrame({"at": np.arange(total.size), "s": total.ravel()})

    found = np.zeros((size + 1) ** 2)
    for r in wide.select(*cols).mapInPandas(run, schema="at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        found[r["at"]] = r["s"]
    found = found.reshape(size + 1, size + 1)
    n = max(found[0, 0], 1.0)
    off = found[0, 1:] / n
    return Moments(int(found[0, 0]), mean, deviation, found[1:, 1:] / n - np.outer(off, off))


SEARCHED = "complexity int, loss double, r2 double, terms int, features array<string>, coefficients array<double>, intercept double, equation string"


def _solved(m: Moments, plan: list[Feature], chosen: tuple[int, ...]) -> tuple[float, int, np.ndarray] | None:
    """Loss, size and coefficients of the line on chosen features; none where they are as good as dependent."""
    c = m.cov[np.ix_(chosen, chosen)]
    if np.linalg.cond(c) > 1e10:
        return None
    slope = np.linalg.solve(c, m.cov[list(chosen), -1])
    unit = m.deviation[-1] if m.deviation[-1] >= FLAT else 1.0
    loss = max(0.0, float(m.cov[-1, -1] - slope @ m.cov[list(chosen), -1])) * float(unit**2)
    return loss, sum(formula_size(plan[k]) + 3 for k in chosen) + 1, slope * unit / m.deviation[list(chosen)]


def _row(m: Moments, plan: list[Feature], chosen: tuple[int, ...], solved: tuple[float, int, np.ndarray]) -> tuple:
    loss, size, coef = solved
    constant = m.mean[-1] - coef @ m.mean[list(chosen)]
    text = " + ".join([f"{a:.6g}*({plan[i].formula})" for a, i in zip(coef, chosen, strict=True)] + [f"{constant:.6g}"])
    r2 = float(1 - loss / m.spread) if m.deviation[-1] >= FLAT else 1.0
    return size, loss, r2, len(chosen), [plan[i].name for i in chosen], [float(a) for a in coef], float(constant), text


def grown(m: Moments, plan: list[Feature], usable: list[int], most_terms: int = 4, beam: int = 8, max_size: int = 30) -> list[tuple]:
    """Lines grown feature by feature from the moments, the best few of each length; rows of ``SEARCHED``."""
    usable = [i for i in usable if m.deviation[i] >= FLAT]
    kept: list[tuple[int, ...]] = [()]
    rows = []
    for _ in range(most_terms):
        found = {}
        for have in kept:
            for i in usable:
                chosen = tuple(sorted({*have, i}))
                if i in have or chosen in found or sum(formula_size(plan[k]) + 3 for k in chosen) + 1 > max_size:
                    continue
                solved = _solved(m, plan, chosen)
                if solved is not None:
                    found[chosen] = solved
        kept = sorted(found, key=lambda k: (found[k][0], found[k][1], k))[:beam]
        rows += [_row(m, plan, k, found[k]) for k in kept]
    return rows


def relevant(m: Moments, plan: list[Feature], functions: set[str] | None, threshold: float = RELEVANCE) -> list[int]:
    """Features of a plan that a grammar's functions allow and that stay: raw ones always, others if not flat and relevant."""
    roots, logs = allowed(functions)
    kinds = {"raw", *(["sqrt", "inv_sqrt", "quotient"] if roots else []), *(["log"] if logs else [])}
    return [i for i, f in enumerate(plan) if f.kind == "raw" or f.kind in kinds and m.deviation[i] >= FLAT and m.r2(i) >= threshold]


def small_models(m: Moments, plan: list[Feature], usable: list[int]) -> list[tuple]:
    """The best line on one feature and the best on two, of all there are; rows of ``SEARCHED``. Ties go to the simpler, then to the earlier features."""
    usable = [i for i in usable if m.deviation[i] >= FLAT]
    rows = []
    for choices in ([(i,) for i in usable], list(combinations(usable, 2))):
        found = {k: s for k in choices if (s := _solved(m, plan, k)) is not None}
        if found:
            best = min(found, key=lambda k: (round(found[k][0] / (m.spread or 1.0), 12), found[k][1], k))
            rows.append(_row(m, plan, best, found[best]))
    return rows


def expected_importance(m: Moments, plan: list[Feature], features: list[str], coefficients: list[float]) -> dict[str, float]:
    """Drop of R² to expect when a feature's values are dealt anew, for a least-squares line: twice its term's share of the target's variance."""
    at = {f.name: i for i, f in enumerate(plan)}
    return {n: float(2 * (a * m.deviation[at[n]]) ** 2 / m.spread) if m.spread else 0.0 for n, a in zip(features, coefficients, strict=True)}


def forward_search(spark: SparkSession, wide: DataFrame, target: str, plan: list[Feature], most_terms: int = 4, beam: int = 8, max_size: int = 30) -> DataFrame:
    """Grow linear combinations of features term by term, keeping the best few of each length.

    The data are read twice, for the moments; every candidate is solved from
    those, in scaled columns. The beam makes it a heuristic. Returns complexity, loss, r2, terms, features, coefficients, intercept and equation.
    """
    m = centred_moments(wide, target, [f.name for f in plan])
    return spark.createDataFrame(grown(m, plan, list(range(len(plan))), most_terms, beam, max_size), SEARCHED)


def predictor(spark: SparkSession, equation: str) -> Callable[[dict[str, Column]], Column]:
    """An equation's text as a function from columns by name to a column; the text is parsed once, by Spark."""
    postfix = spark.range(1).select(tree.parsed(F.lit(equation)).alias("t")).first()["t"]
    if postfix is None:
        raise ValueError(f"no formula: {equation}")
    two = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: F.try_divide(x, y), "^": F.pow}
    one = {"log": F.ln, "~": lambda x: -x} | {f: getattr(F, f) for f in text.FUNCTIONS if f != "log"}

    def predict(columns: dict[str, Column]) -> Column:
        stack: list[Column] = []
        for t in postfix:
            if t in two:
                y, x = stack.pop(), stack.pop()
                stack.append(two[t](x, y))
            elif t in one:
                stack.append(one[t](stack.pop()))
            else:
                stack.append(F.lit(float(t)) if t[0].isdigit() or t[0] == "." else columns[t])
        return stack[0]

    return predict
