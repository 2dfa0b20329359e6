"""Vector compression by product codes whose nearest entries are found with bitmasks.

A vector in whole numbers is cut into ``PARTS`` equal parts, and each part is
replaced by the number of the nearest entry of its codebook. Nearest entries
come from slicing and intersecting: for each dimension of a part the entries'
coordinates are sorted once, and the prefixes of that order are kept as 64-bit
masks of entries. A range of half-width ``radius`` around a coordinate is two
binary searches and the difference of two masks; the masks of all dimensions,
ANDed, are the entries in a box. The nearest entry of the box is the nearest of
all when it is no farther than the radius; else the search is made again with
that distance, or a doubled radius where the box is empty. So it is exact.

Codebooks start as the parts of the 64 vectors of smallest vec_id; in each
round Spark sums counts and coordinates per entry over all vectors, and only
those sums, whose number is fixed, reach the driver.

Defined cases: rows without whole numbers (see :mod:`.vectors`) are left out;
vectors of each length have codebooks of their own; a vector whose length is
no positive multiple of ``PARTS`` has null code, error and codebook hash and
adds nothing to its label's error; equal and null ids are ordered by vector, null
ids last; fewer than 64 vectors make fewer entries; equal entries tie to the
lower; errors that no long holds are null; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import halves, joined_halves, long_or_null, matrix, whole_numbers

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Magnitude from which squared distances are computed in numbers of any size.
LARGE = 1 << 27
#: Part vectors searched at once.
BLOCK = 8192


class Codebook:
    """Entries of one part, with sorted coordinates and prefix masks of each dimension."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.width = entries.shape[1]
        self.large = bool(entries.size) and max(abs(int(entries.min())), abs(int(entries.max()))) >= LARGE
        bits = np.uint64(1) << np.arange(len(entries), dtype=np.uint64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        start = np.zeros((1, self.width), dtype=np.uint64)
        self.masks = np.concatenate([start, np.bitwise_or.accumulate(bits[order], axis=0)])
        self.radius = self._spacing()

    def _spacing(self) -> int:
        """The first radius: the median distance between an entry and the nearest different one."""
        e = self.entries.astype(float)
        apart = ((e[:, None] - e[None]) ** 2).sum(axis=2)
        apart[apart == 0] = np.inf
        near = apart.min(axis=1) if len(e) else np.zeros(0)
        near = near[np.isfinite(near)]
        return max(1, int(np.sqrt(np.median(near)))) if len(near) else 1

    def inside(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the entries whose every coordinate is within the radius of the vector's."""
        found = None
        for d in range(self.width):
            low = np.searchsorted(self.sorted[:, d].astype(x.dtype), x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d].astype(x.dtype), x[:, d] + radius, "right")
            mask = self.masks[high, d] & ~self.masks[low, d]
            found = mask if found is None else found & mask
        return found

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each vector, the lowest of equally near ones, and its squared distance."""
        large = self.large or bool(x.size) and max(abs(int(x.min())), abs(int(x.max()))) >= LARGE
        kind = object if large else np.int64
        code, error = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=kind)
        for at in range(0, len(x), BLOCK):
            code[at : at + BLOCK], error[at : at + BLOCK] = self._nearest(x[at : at + BLOCK].astype(kind), kind)
        return code, error

    def _nearest(self, x: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        entries = self.entries.astype(kind)
        code, error = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=kind)
        left = np.arange(len(x))
        radius = np.full(len(x), self.radius, dtype=kind)
        shifts = np.arange(len(entries), dtype=np.uint64)
        # Farther than any distance that the numbers at hand can have.
        beyond = 4 * self.width * (1 << 130 if kind is object else LARGE * LARGE)
        while len(left):
            own = x[left]
            box = (self.inside(own, radius)[:, None] >> shifts) & np.uint64(1)
            row, entry = np.nonzero(box)
            off = own[row] - entries[entry]
            apart = np.full(box.shape, beyond, dtype=kind)
            apart[row, entry] = (off * off).sum(axis=1)
            best = apart.argmin(axis=1)
            least = apart[np.arange(len(left)), best]
            sure = (least <= radius * radius).astype(bool)
            code[left[sure]], error[left[sure]] = best[sure], least[sure]
            empty = (least == beyond).astype(bool)
            # One more than the root, so that a rounded root never falls short.
            root = np.array([int(v**0.5) + 1 for v in least], dtype=kind) if kind is object else np.sqrt(least.astype(float)).astype(np.int64) + 1
            if kind is object:
                root = np.array([r + (r >> 40) for r in root], dtype=kind)
            radius = np.where(empty, 2 * radius, root)[~sure]
            left = left[~sure]
        return code, error


def _parts(x: np.ndarray, parts: int) -> list[np.ndarray]:
    width = x.shape[1] // parts
    return [x[:, p * width : (p + 1) * width] for p in range(parts)]


def first_entries(rows: DataFrame, dim: int, parts: int, entries: int, vec_id: str) -> list[np.ndarray]:
    """Parts of the vectors of smallest id; at most ``entries`` rows are fetched."""
    low = rows.where(F.size("x") == dim).orderBy(F.asc_nulls_last(vec_id), "x").select("x").limit(entries).collect()
    return _parts(np.array([r["x"] for r in low], dtype=np.int64).reshape(-1, dim), parts)


def moved(rows: DataFrame, dim: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry as the floored mean of the parts nearest to it; entries that nothing is nearest to stay."""
    width = dim // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Codebook(b) for b in books]
        size = max(len(b) for b in books)
        count = np.zeros((len(books), size), dtype=np.int64)
        high, low = (np.zeros((len(books), size, width), dtype=np.int64) for _ in range(2))
        for batch in batches:
            for p, (own, book) in enumerate(zip(_parts(matrix(batch.column(0), dim), len(books)), known, strict=True)):
                code, _ = book.nearest(own)
                count[p] += np.bincount(code, minlength=size)
                for total, half in zip((high, low), halves(own), strict=True):
                    np.add.at(total[p], code, half)
        part, entry = np.nonzero(count)
        for d in range(width):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(np.full(len(part), d, dtype=np.int32)), *(pa.array(t) for t in (count[part, entry], high[part, entry, d], low[part, entry, d]))],
                ["part", "entry", "place", "n", "high", "low"],
            )

    sums = rows.where(F.size("x") == dim).select("x").mapInArrow(run, "part int, entry int, place int, n long, high long, low long")
    out = [b.copy() for b in books]
    # A row per part, entry and place in it: as many as a codebook has numbers.
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        out[r["part"]][r["entry"], r["place"]] = joined_halves(r["high"], r["low"]) // r["n"]
    return out


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def coded(rows: DataFrame, dim: int, books: list[np.ndarray] | None, keep: list[str]) -> DataFrame:
    """The kept columns with code, squared error and hash of the codebooks; nulls without codebooks."""
    known_digest = digest(books) if books is not None else None
    made = rows.where(F.size("x") == dim).select(*keep, "x")
    if books is None:
        return made.select(*keep, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("string").alias("codebooks_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Codebook(b) for b in books]
        names = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            m = batch.num_rows
            found = [book.nearest(own) for own, book in zip(_parts(matrix(batch.column(len(keep)), dim), len(books)), known, strict=True)]
            code = names[np.column_stack([c for c, _ in found]).reshape(m, len(books))]
            error = reduce(np.add, (e.astype(object) for _, e in found))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(["".join(r) for r in code], pa.string()), long_or_null(error.tolist()), pa.array([known_digest] * m, pa.string())],
                [*keep, "code", "error", "codebooks_sha256"],
            )

    fields = [rows.schema[c] for c in keep]
    return made.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["code string, error long, codebooks_sha256 string"]))


def compressed(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of each vector, and the codebooks by vector length."""
    if not 1 <= entries <= 64:
        raise ValueError("a mask holds 1 to 64 entries")
    vectors = cut(whole_numbers(rows, "vec_id", "label"))
    keep = ["vec_id", "label"]
    dims = sorted(r["dim"] for r in vectors.select(F.size("x").alias("dim")).distinct().collect())
    books: dict[int, list[np.ndarray]] = {}
    for dim in (d for d in dims if d and d % parts == 0):
        books[dim] = first_entries(vectors, dim, parts, entries, "vec_id")
        for _ in range(rounds):
            books[dim] = moved(vectors, dim, books[dim])
    every = [coded(vectors, d, books.get(d), keep) for d in dims] or [coded(vectors, 0, None, keep)]
    codes = cut(reduce(DataFrame.unionByName, every))
    # Sums are exact beyond 64 bits; there is a row per label, which adaptive execution sends whole to every task when it is small, else splits a hot label's rows.
    beyond = F.coalesce(F.bool_or(F.col("code").isNotNull() & F.col("error").isNull()), F.lit(False))
    total = F.coalesce(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(0))
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.when(~beyond, total).alias("total"))
    found = codes.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return found.select("vec_id", "label", "code", "error", F.expr("try_cast(total AS bigint)").alias("label_error"), "codebooks_sha256"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = compressed(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
