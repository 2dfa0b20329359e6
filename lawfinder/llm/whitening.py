"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

The distinct vectors, in whole numbers and centred, are the rows of a matrix
A that stays in files. Each step multiplies A by the next right vector and,
in the same scan, A's transpose by the result, so that a step is one Spark
job whose sums have a few numbers per dimension. What those sums give is made
orthogonal to all earlier vectors, left and right (full reorthogonalisation).
The singular values of the small bidiagonal matrix are the deviations, and
its right vectors, turned by those of the steps, the components.

A left vector has an entry per row. It is never stored: it is A times a short
vector ``w``, so tasks make its entries anew while they scan, and a lost
executor loses nothing.

Steps end when the leading components have converged to rounding and a fresh
start beside them finds no greater one (components of equal deviation have
only one direction in what a start can reach), or when there are as many
steps as dimensions.

Defined cases: rows without whole numbers (see :mod:`.vectors`) are left out;
vectors of each length are a table of their own, fitted and whitened alone;
equal vectors count once in the fit and get a row each in the result; rows
may share a vec_id or lack one; directions whose variance is under ``FLAT``
of the whole have no component, so that a table of equal vectors, or of one,
gives no rows; a deviation that no long holds is null; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_cut, table
from .vectors import halves, joined_halves, long_or_null, matrix, squared_sum, whole_numbers

COMPONENTS = 4
#: Share of the whole variance under which a direction counts as flat.
FLAT = 1e-12
#: Length, against the norm of A, under which a new left or right vector counts as none.
NOTHING = 1e-10
#: Error of a leading component at which it has converged, against the norm of A.
ROUNDING = 4 * float(np.finfo(float).eps)
#: Steps between looks at the bidiagonal matrix.
LOOK = 4

_ROWS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """What was learned of the vectors of one length."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    steps: int
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def summed(rows: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of ``part(X)``, an array of ``size`` numbers per batch X; tasks add up their own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = part(matrix(batch.column(0), dim))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "s"])

    kind = "long" if part(np.zeros((1, dim), dtype=np.int64)).dtype == np.int64 else "double"
    sums = rows.select("x").mapInArrow(run, f"at int, s {kind}").groupBy("at").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(size, dtype=np.int64 if kind == "long" else float)
    for r in sums:
        out[r["at"]] = r["s"]
    return out


def fitted(fit: DataFrame, dim: int, k: int = COMPONENTS, seed: int = 11) -> Whitening:
    """Components and variances of the rows of ``fit`` (distinct vectors ``x``), which is read once a step."""
    found = summed(fit, dim, lambda x: np.concatenate([[len(x)], *(h.sum(axis=0) for h in halves(x))]), 2 * dim + 1)
    n, sums = int(found[0]), [joined_halves(h, low) for h, low in zip(found[1 : dim + 1], found[dim + 1 :], strict=True)]
    mean = np.array([s / n for s in sums])
    norm = float(np.sqrt(summed(fit, dim, lambda x: np.array([((x - mean) ** 2).sum()]), 1)[0]))
    made = Whitening(n, sums, np.zeros((0, dim)), np.zeros(0), norm * norm / n, 0)
    if not norm:
        return made
    rng = np.random.default_rng(seed)
    right = np.zeros((dim, 0))  # right vectors
    short = np.zeros((dim, 0))  # left vectors, each A times a column
    back = np.zeros((dim, 0))  # A's transpose times each left vector
    small = np.zeros((0, 0))  # the bidiagonal matrix

    def across(v: np.ndarray) -> np.ndarray:
        return v - right @ (right.T @ v)

    def fresh() -> np.ndarray:
        v = across(across(rng.normal(size=dim)))
        return v / np.linalg.norm(v)

    def left(y: np.ndarray, used: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Squared length of u = A y, its products with all left vectors, and A's transpose times u."""
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            u = centred @ y
            return np.concatenate([[u @ u], (centred @ used).T @ u, centred.T @ u])

        s = summed(fit, dim, part, 1 + used.shape[1] + dim)
        return float(s[0]), s[1 : 1 + used.shape[1]], s[1 + used.shape[1] :]

    v, beta, began = fresh(), 0.0, 0
    while right.shape[1] < dim:
        j = right.shape[1]
        right = np.column_stack([right, v])
        w = v - beta * short[:, -1] if j and beta else v
        length, shared, down = left(w, short)
        w, down = w - short @ shared, down - back @ shared
        if shared @ shared > 1e-4 * length:  # most of it was not new, so what is left is rough
            length, shared, down = left(w, short)
            w, down = w - short @ shared, down - back @ shared
        alpha = float(np.sqrt(max(0.0, length - shared @ shared)))
        grown = np.zeros((j + 1, j + 1))
        grown[:j, :j] = small
        if j:
            grown[j - 1, j] = beta
        if alpha <= NOTHING * norm:  # A has nothing more in this direction
            alpha, beta = 0.0, 0.0
            short, back = (np.column_stack([m, np.zeros(dim)]) for m in (short, back))
        else:
            short, back = np.column_stack([short, w / alpha]), np.column_stack([back, down / alpha])
            v = across(across(back[:, -1]))
            beta = float(np.linalg.norm(v))
        grown[j, j] = alpha
        small = grown
        if j + 1 == dim:
            break
        if beta <= NOTHING * norm:
            v, beta, restart = fresh(), 0.0, True
        else:
            v, restart = v / beta, False
        if restart or j % LOOK == LOOK - 1:
            turn, values, _ = np.linalg.svd(small)
            own_turn, own, _ = np.linalg.svd(small[began:, began:])
            ready = len(values) >= k and (beta * np.abs(turn[-1, :k]) <= ROUNDING * norm).all()
            off = beta * abs(own_turn[-1, 0])
            if ready and began and own[0] + off < values[k - 1] and off <= 0.05 * own[0]:
                break  # the last fresh start leads to none of the leading components
            if ready and not restart:
                v, beta, restart = fresh(), 0.0, True
        if restart:
            began = j + 1
    _, values, turned = np.linalg.svd(small)
    variances = values**2 / n
    keep = np.flatnonzero(variances > FLAT * made.trace)[:k]
    made.components, made.variances, made.steps = turned[keep] @ right.T, variances[keep], right.shape[1]
    made.identity_error = identity_error(fit, made, dim)
    return made


def whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    return (x - model.mean) @ model.components.T / np.sqrt(model.variances)


def identity_error(fit: DataFrame, model: Whitening, dim: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance, less the identity; one scan."""
    k = len(model.variances)
    if not k:
        return 0.0

    def part(x: np.ndarray) -> np.ndarray:
        z = whitened(x, model)
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    s = summed(fit, dim, part, k + k * k)
    centre = s[:k] / model.n
    return float(np.abs(s[k:].reshape(k, k) / model.n - np.outer(centre, centre) - np.eye(k)).max())


def with_components(rows: DataFrame, model: Whitening, dim: int, keep: list[str]) -> DataFrame:
    """A row for each vector ``x`` of ``dim`` numbers and component: its exact deviation and its whitened coordinate."""
    k = len(model.variances)
    fields = [rows.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = matrix(batch.column(len(keep)), dim)
            most = max(abs(int(x.min())), abs(int(x.max())), *map(abs, model.sums))
            off = (x if 2 * model.n * most < 1 << 62 else x.astype(object)) * model.n - np.array(model.sums, dtype=None if 2 * model.n * most < 1 << 62 else object)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(each) for i in range(len(keep))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                 long_or_null(squared_sum(off)).take(each), pa.array(whitened(x, model).ravel()), pa.array(np.tile(model.variances / model.trace, m)), pa.array(np.full(m * k, model.identity_error))],
                [*keep, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [_ROWS])
    made = rows.where((F.size("x") == dim) & F.lit(k > 0))
    return made.select(*keep, "x").mapInArrow(run, schema)


def whitening(rows: DataFrame, components: int = COMPONENTS, keep: tuple[str, ...] = ("vec_id",)) -> tuple[DataFrame, dict[int, Whitening]]:
    """Whitened coordinates of every vector on the leading components, and what was learned, by length."""
    vectors = whole_numbers(rows, *keep)
    distinct = cut(vectors.select("x").distinct().withColumn("dim", F.size("x")))
    dims = sorted(r["dim"] for r in distinct.where("dim > 0").select("dim").distinct().collect())
    models = {d: fitted(distinct.where(F.col("dim") == d), d, components) for d in dims}
    drop_cut(distinct)
    parts = [with_components(vectors, m, d, list(keep)) for d, m in models.items()]
    none = Whitening(1, [0], np.zeros((0, 1)), np.zeros(0), 0.0, 0)
    return reduce(DataFrame.unionByName, parts or [with_components(vectors, none, 1, list(keep))]), models


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(table(spark, sf_dir, "embeddings"))[0]
