"""Constants inside functions, by variable projection.

A model is a line in terms ``f(x, b)``, each with a constant ``b`` inside. For
fixed constants the line is solved exactly, so only the constants are
searched: every pass sends all rows through all models at their present
constants once. Tasks sum the variances and covariances of the terms, of
their slopes in ``b``, and of the target over Arrow batches, a row per model
and task, and Spark joins those by model. From those few numbers a model
takes a Gauss-Newton step (the line's share taken out of the slopes), damped
until its loss falls. What reaches the driver has a row per model, whatever
the number of rows. Different rows are written down once with how often
they occur, spread over tasks by their number, as a file may be one task's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import cut, drop_cut
from .once import spread
from .stats import FLAT

#: Greatest argument of an exponential, as in the guarded transforms.
STEEPEST = 50.0
#: Share of the target's variance under which a loss is the rounding of the sums, and counts as none.
ROUNDING = 1e-13

Both = tuple[np.ndarray, np.ndarray]


def _exp(at: np.ndarray, inner: np.ndarray) -> Both:
    """An exponential of ``at``, whose own slope is ``inner``; flat where its argument is cut off."""
    value = np.exp(np.clip(at, -STEEPEST, STEEPEST))
    return value, np.where(np.abs(at) < STEEPEST, inner * value, 0.0)


def _power(x: np.ndarray, b: float) -> Both:
    value = np.power(x, b)
    return value, value * np.log(x)


def _sqrt(x: np.ndarray, b: float) -> Both:
    value = np.sqrt(x + b)
    return value, 0.5 / value


def _inverse(x: np.ndarray, b: float) -> Both:
    value = 1 / (x + b)
    return value, -value * value


def _tanh(x: np.ndarray, b: float) -> Both:
    value = np.tanh(b * x)
    return value, x * (1 - value * value)


@dataclass(frozen=True)
class Form:
    """A function with a constant: its value and slope in the constant, text, nodes, the operator it needs, and where to start."""

    name: str
    both: Callable[[np.ndarray, float], Both]
    text: Callable[[str, str], str]
    size: int
    needs: str
    starts: Callable[[dict], list[float]]
    positive: bool = False


def _scaled(counts: list[float], of: str) -> Callable[[dict], list[float]]:
    return lambda s: [c / s[of] for c in counts] if s[of] else []


_SIGNED = [c * sign for c in (0.1, 0.5, 2.0, 6.0) for sign in (1, -1)]
_BEYOND = lambda s: [c * s["range"] - s["least"] for c in (0.01, 0.1, 0.5, 2.0, 10.0)] if s["range"] else []
FORMS = (
    Form("raw", lambda x, b: (x, np.zeros(len(x))), lambda x, b: x, 1, "", lambda s: [0.0] if s["range"] else []),
    Form("exp", lambda x, b: _exp(b * x, x), lambda x, b: f"exp({b}*{x})", 4, "exp", _scaled(_SIGNED, "range")),
    Form("exp_inverse", lambda x, b: _exp(b / x, 1 / x), lambda x, b: f"exp({b}/{x})", 4, "exp", lambda s: [c / s["inverse_range"] for c in _SIGNED] if s["inverse_range"] else [], True),
    Form("power", _power, lambda x, b: f"{x}^({b})", 3, "^", lambda s: [-3.0, -1.5, -0.6, 0.4, 1.4, 2.5], True),
    Form("log", lambda x, b: (np.log(x + b), 1 / (x + b)), lambda x, b: f"log({x} + {b})", 4, "log", _BEYOND),
    Form("sqrt", _sqrt, lambda x, b: f"sqrt({x} + {b})", 4, "sqrt", _BEYOND),
    Form("inverse", _inverse, lambda x, b: f"1/({x} + {b})", 5, "/", _BEYOND),
    Form("sin", lambda x, b: (np.sin(b * x), x * np.cos(b * x)), lambda x, b: f"sin({b}*{x})", 4, "sin", _scaled([1.0, 2.0, 3.5, 5.0, 7.0, 9.0, 12.0], "range")),
    Form("cos", lambda x, b: (np.cos(b * x), -x * np.sin(b * x)), lambda x, b: f"cos({b}*{x})", 4, "cos", _scaled([1.0, 2.0, 3.5, 5.0, 7.0, 9.0, 12.0], "range")),
    Form("tanh", _tanh, lambda x, b: f"tanh({b}*{x})", 4, "tanh", _scaled([0.3, 1.0, 3.0, 10.0], "range")),
)
BY_NAME = {f.name: f for f in FORMS}
#: Forms that a model may hold twice of one feature, with two constants.
AGAIN = ("exp", "sin", "cos")


@dataclass
class Model:
    """Terms as (form, feature) with their constants, and the line found for them."""

    terms: tuple[tuple[str, str], ...]
    constants: np.ndarray
    loss: float = float("inf")
    step: np.ndarray = field(default_factory=lambda: np.zeros(0))
    damping: float = 1.0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0
    settled: bool = False

    @property
    def size(self) -> int:
        return sum(BY_NAME[f].size + 3 for f, _ in self.terms) + 1


def shapes(df: DataFrame, names: list[str]) -> dict[str, dict]:
    """Least value, range, and range of the inverse of each column, from one pass."""
    c = lambda n: F.col(f"`{n}`").cast("double")
    found = df.agg(*[a for i, n in enumerate(names) for a in (F.min(c(n)).alias(f"l{i}"), F.max(c(n)).alias(f"m{i}"))]).first()
    out = {}
    for i, n in enumerate(names):
        low, high = found[f"l{i}"], found[f"m{i}"]
        if low is None or not np.isfinite([low, high]).all():
            continue
        out[n] = {"least": low, "range": high - low, "positive": low > 0, "inverse_range": 1 / low - 1 / high if low > 0 else 0.0}
    return out


class _Sums:
    """Rows, means and summed products of deviations of each model's values; models of a value that is not finite fall out."""

    def __init__(self, models: int, width: int):
        self.n, self.mean, self.products, self.sound = 0.0, np.zeros((models, width)), np.zeros((models, width, width)), np.ones(models, dtype=bool)

    def add(self, n: float, mean: np.ndarray, products: np.ndarray, sound: np.ndarray) -> None:
        self.sound &= sound
        off = mean - self.mean
        total = self.n + n
        self.mean += off * (n / total)
        self.products += products + off[:, :, None] * off[:, None, :] * (self.n * n / total)
        self.n = total


def _of_batch(times: np.ndarray, y: np.ndarray, xs: list[np.ndarray], models: list[list[tuple[str, int, float]]], sound: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of one batch, whose rows count some times each, for the models that were sound so far."""
    k = len(models[0])
    width = 2 * k + 1
    mean, products, good = np.zeros((len(models), width)), np.zeros((len(models), width, width)), sound.copy()
    known: dict[tuple[str, int, float], Both] = {}
    v = np.empty((width, len(y)))
    v[-1] = y
    n = times.sum()
    for i in np.flatnonzero(sound):
        for j, term in enumerate(models[i]):
            if term not in known:
                known[term] = BY_NAME[term[0]].both(xs[term[1]], term[2])
            v[j], v[k + j] = known[term]
        # one by one: a product of matrices would start threads in every task
        own = np.array([row @ times for row in v]) / n
        if not np.isfinite(own).all():
            good[i] = False
            continue
        off = v - own[:, None]
        counted = off * times
        mean[i] = own
        for a in range(width):
            for b in range(a, width):
                products[i, a, b] = products[i, b, a] = off[a] @ counted[b]
    return n, mean, products, good


_PARTS = "m int, n double, sound boolean, mean array<double>, products array<double>"


def _part(m: int, n: float, sound: bool, mean: np.ndarray, products: np.ndarray) -> dict:
    return {"m": m, "n": n, "sound": sound, "mean": mean.tolist(), "products": products.ravel().tolist()}


_ARROW = pa.schema([("m", pa.int32()), ("n", pa.float64()), ("sound", pa.bool_()), ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])


def _moments(df: DataFrame, target: str, names: list[str], models: list[tuple[int, Model]], trials: list[np.ndarray], times: str | None = None) -> dict[int, tuple[np.ndarray, np.ndarray] | None]:
    """Means and covariances of each model's terms, slopes and the target, of all models in one pass; none where a value is not finite.

    ``times`` names a column that says how often a row counts.
    """
    width = 2 * len(models[0][1].terms) + 1
    numbers = [at for at, _ in models]
    listed = [[(f, names.index(x), float(c)) for (f, x), c in zip(m.terms, b, strict=True)] for (_, m), b in zip(models, trials, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(len(listed), width)
        with np.errstate(all="ignore"):
            for batch in batches:
                if batch.num_rows:
                    often, y, *xs = [c.to_numpy(zero_copy_only=False) for c in batch.columns]  # nulls become nan
                    sums.add(*_of_batch(often, y, xs, listed, sums.sound))
        if sums.n:
            yield pa.RecordBatch.from_pylist([_part(m, sums.n, bool(sums.sound[i]), sums.mean[i], sums.products[i]) for i, m in enumerate(numbers)], _ARROW)

    def joined(rows: pa.Table) -> pa.Table:
        """The parts of one model, of which each task gives one."""
        sums = _Sums(1, width)
        with np.errstate(all="ignore"):
            for r in rows.to_pylist():
                sums.add(r["n"], np.array([r["mean"]]), np.array(r["products"]).reshape(1, width, width), np.array([r["sound"]]))
        return pa.Table.from_pylist([_part(rows.column("m")[0].as_py(), sums.n, bool(sums.sound[0]), sums.mean[0], sums.products[0])], _ARROW)

    often = F.lit(1.0) if times is None else F.col(times).cast("double")
    rows = df.select(often.alias("often"), *[F.col(f"`{n}`").cast("double").alias(f"c{i}") for i, n in enumerate([target, *names])])
    out: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}
    for r in rows.mapInArrow(run, _PARTS).groupBy("m").applyInArrow(joined, _PARTS).collect():
        cov = np.array(r["products"]).reshape(width, width) / r["n"]
        out[r["m"]] = (np.array(r["mean"]), cov) if r["sound"] and np.isfinite(cov).all() else None
    return out


def _solved(mean: np.ndarray, cov: np.ndarray, k: int) -> tuple[float, np.ndarray, float, np.ndarray] | None:
    """Loss, coefficients and intercept of the line at fixed constants, and the Gauss-Newton step of the constants."""
    spread = np.sqrt(np.diag(cov))
    if (spread[:k] < 1e-150).any() or spread[-1] == 0:
        return None
    terms, y = cov[:k, :k], cov[:k, -1]
    scaled = terms / np.outer(spread[:k], spread[:k])
    if np.linalg.cond(scaled) > 1e12:
        return None
    a = np.linalg.solve(scaled, y / spread[:k]) / spread[:k]
    loss = max(0.0, float(cov[-1, -1] - a @ y))
    # Slopes with what the terms' line explains of them taken out, times their coefficients: the projected Jacobian.
    slopes, cross = cov[k : 2 * k, k : 2 * k], cov[k : 2 * k, :k]
    back = np.linalg.solve(scaled, (cross / spread[:k]).T) / spread[:k, None]
    left = (slopes - cross @ back) * np.outer(a, a)
    toward = a * (cov[k : 2 * k, -1] - cross @ a)
    size = np.sqrt(np.maximum(np.diag(left), 0.0))
    step = np.zeros(k)
    good = size > 1e-150
    if good.any():
        unit = left[np.ix_(good, good)] / np.outer(size[good], size[good]) + 1e-12 * np.eye(good.sum())
        step[good] = np.linalg.lstsq(unit, toward[good] / size[good], rcond=None)[0] / size[good]
    return loss, a, float(mean[-1] - a @ mean[:k]), step


def improved(df: DataFrame, target: str, names: list[str], models: list[Model], passes: int, tolerance: float = 1e-9, times: str | None = None) -> tuple[list[Model], int]:
    """Up to ``passes`` steps of all models together, each a pass over all rows; also how many passes were made."""
    models, made = [replace(m) for m in models], 0
    for _ in range(passes):
        open_ = [(i, m) for i, m in enumerate(models) if not m.settled]
        if not open_:
            break
        trials = [m.constants if not np.isfinite(m.loss) else m.constants + m.damping * m.step for _, m in open_]
        found = _moments(df, target, names, open_, trials, times)
        made += 1
        for (i, m), b in zip(open_, trials, strict=True):
            moments = found.get(i)
            solved = _solved(*moments, len(m.terms)) if moments is not None else None
            if solved is not None and solved[0] < m.loss:
                small = np.isfinite(m.loss) and (np.abs(b - m.constants) <= tolerance * np.maximum(np.abs(b), 1e-300)).all()
                m.constants, (m.loss, m.coefficients, m.intercept, m.step) = b, solved
                m.damping, m.settled = min(1.0, 2 * m.damping), bool(small) or not m.step.any()
            elif not np.isfinite(m.loss):
                m.settled = True  # no value where it was to start
            else:
                m.damping /= 4
                m.settled = bool((np.abs(m.damping * m.step) <= tolerance * np.maximum(np.abs(m.constants), 1e-300)).all())
    return models, made


def fit_constants(
    spark: SparkSession, df: DataFrame, target: str, names: list[str], functions: set[str] | None = None, most_terms: int = 2, beam: int = 4, passes: int = 12,
) -> tuple[DataFrame, int]:
    """Sums of functions with fitted constants inside: (terms, complexity, loss, r2, forms, features, constants, coefficients, intercept, equation), and the passes made.

    ``functions`` are the operators and functions allowed (all, if none are
    given). Each form starts from several constants per feature; after two
    passes the best start of each goes on, after four more the best
    ``2 * beam``. A model of more terms starts from the best ``beam`` of one
    less with each form and feature added. Local minima are possible,
    as with any descent. Models are ranked by n ln(loss) + ln(n) for each
    constant inside (Schwarz's criterion), so that a form which comes near
    the raw column at the end of its constants does not push that one out;
    of those whose losses are mere rounding the simplest counts as best.
    """
    used = list(dict.fromkeys([target, *names]))
    cols, times = [f"c{i}" for i in range(len(used))], "__times"
    each = df.select(*[F.col(f"`{n}`").cast("double").alias(c) for n, c in zip(used, cols, strict=True)]).groupBy(*cols).agg(F.count(F.lit(1)).alias(times))
    # In another order than they are grouped by, else Spark leaves this exchange out and puts small tables into one task.
    df = cut(spread(each, *reversed(cols))).toDF(*used, times)
    y = F.col(f"`{target}`")
    n_rows, total = df.agg(F.sum(times), F.sum(F.col(times) * y)).first()
    variance = 0.0 if total is None else df.agg(F.sum(F.col(times) * F.pow(y - total / n_rows, F.lit(2.0)))).first()[0] / n_rows
    loss_of = lambda m: m.loss if m.loss > ROUNDING * variance else 0.0

    def rank(m: Model) -> float:
        inside = sum(f != "raw" for f, _ in m.terms)
        return n_rows * np.log(loss_of(m)) + inside * np.log(n_rows) if loss_of(m) else -np.inf

    seen = shapes(df, names)
    allowed = [f for f in FORMS if functions is None or not f.needs or f.needs in functions]
    singles = [(f.name, n) for f in allowed for n in names if n in seen and (seen[n]["positive"] or not f.positive)]
    starts = {s: BY_NAME[s[0]].starts(seen[s[1]]) for s in singles}
    made = 1
    kept: list[Model] = [Model((), np.zeros(0))]
    rows: list[Model] = []
    for count in range(1, most_terms + 1):
        begun = [Model((*m.terms, s), np.append(m.constants, b)) for m in kept for s in singles for b in starts[s] if s not in m.terms or s[0] in AGAIN]
        held = begun
        for rounds, of in ((2, lambda m: m.terms), (4, lambda m: m.terms), (passes - 6, None)):
            held, n = improved(df, target, names, held, rounds, times=times)
            made += n
            held = sorted((m for m in held if np.isfinite(m.loss)), key=lambda m: (rank(m), m.size, m.terms, m.loss))
            if of is not None:
                best: dict = {}
                for m in held:
                    best.setdefault(of(m), m)
                held = list(best.values())[: 2 * beam if rounds == 4 else None]
        rows += held
        kept = held[:beam]
        if not kept:
            break
    drop_cut(df)
    found = []
    for m in rows:
        texts = [BY_NAME[f].text(x, f"{b:.9g}" if b >= 0 else f"({b:.9g})") for (f, x), b in zip(m.terms, m.constants, strict=True)]
        equation = " + ".join([f"{a:.9g}*{t}" for a, t in zip(m.coefficients, texts, strict=True)] + [f"{m.intercept:.9g}"])
        found.append((len(m.terms), m.size, loss_of(m), 1 - loss_of(m) / variance if variance >= FLAT**2 else 1.0, [f for f, _ in m.terms], [x for _, x in m.terms], [float(b) for b in m.constants], [float(a) for a in m.coefficients], m.intercept, equation))
    schema = "terms int, complexity int, loss double, r2 double, forms array<string>, features array<string>, constants array<double>, coefficients array<double>, intercept double, equation string"
    return spark.createDataFrame(found, schema), made + 1
