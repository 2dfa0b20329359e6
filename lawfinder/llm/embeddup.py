"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learned on a bounded sample so that the
signs of the rotated coordinates are balanced and close to the coordinates
themselves. Each vector's sign bits are split into disjoint substrings, one
per table; vectors that agree on a substring meet in that table's bucket and
are compared there by their exact cosine.

How often vectors at the threshold agree depends on the data (a common part
of all vectors, axes of unlike spread). So it is measured, with the rotations
learned: on partners made for sample vectors at exactly the threshold, in
directions of all kinds and in those in which the data differ. Tables are
added, and substrings shortened, until the share that meets is the target.
Vectors of each length have an index of their own; where no label has more
than ``BUCKET`` of a length, all its vectors share a bucket.

Defined cases: vectors that are null, zero, or hold null or non-finite
components link with nothing, as do those with a null label; vectors of
different lengths do not link; equal vectors of one label are one class,
compared once and counted fully; rows that share a vec_id are judged each by
its own vector; rows without one are linked and counted like others; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, components, cut, numbered, table

THRESHOLD = 0.93
#: Vectors on which rotations are fitted and agreement is measured, at most, and their components, at most; every vector is indexed.
SAMPLE, COMPONENTS = 20_000, 8_000_000
#: Mean vectors of a label in a bucket, which sets the first substring length tried.
BUCKET = 64
TARGET_RECALL = 0.97
#: Tables beyond which substrings are shortened instead.
TABLES = 64
#: Partners at the threshold on which agreement is measured.
MEASURED = 2_000
#: Vectors of a bucket that are compared with as many others in one step.
BLOCK = 512


def learned_rotation(sample: np.ndarray, seed: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation of iterative quantisation: alternate signs and the best rotation onto them."""
    dim = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dim)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    projected = centred @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(projected @ turn >= 0, 1.0, -1.0).T @ projected)
        turn = (u @ v).T
    return mean, axes @ turn


def partners(unit: np.ndarray, threshold: float, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Vectors with partners at exactly the threshold: half in any direction, half in that of another vector of the sample."""
    rng = np.random.default_rng(seed)
    one = unit[rng.integers(0, len(unit), min(MEASURED, 4 * len(unit)))]
    toward = np.where(np.arange(len(one))[:, None] % 2, rng.normal(size=one.shape), unit[rng.integers(0, len(unit), len(one))] - one)
    across = toward - (toward * one).sum(axis=1, keepdims=True) * one
    size = np.linalg.norm(across, axis=1, keepdims=True)
    good = size[:, 0] > 1e-9
    one, across = one[good], across[good] / size[good]
    return one, threshold * one + math.sqrt(1 - threshold * threshold) * across


class Index:
    """Rotations, substring length and tables for the vectors of one length, planned on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, vectors: int, threshold: float, target: float, bucket: int = BUCKET):
        self.dim = sample.shape[1]
        self.bits = 0 if vectors <= bucket else min(30, max(6, math.ceil(math.log2(vectors / bucket))))
        self.tables, self.recall = 1, 1.0
        self.rotations: list[tuple[np.ndarray, np.ndarray]] = []
        one, two = partners(sample, threshold) if len(sample) else (sample, sample)
        while self.bits and self.dim > 1:
            self.tables, self.recall = 0, 0.0
            while self.tables < TABLES and self.recall < target:
                self.tables += 4
                while len(self.rotations) * self.dim < self.bits * self.tables:
                    self.rotations.append(learned_rotation(sample, len(self.rotations)))
                agree = substrings(one, self.rotations, self.bits, self.tables) == substrings(two, self.rotations, self.bits, self.tables)
                self.recall = float(agree.any(axis=1).mean()) if len(one) else 1.0
            if self.recall >= target:
                return
            self.bits -= 1
        self.bits, self.tables, self.recall, self.rotations = 0, 1, 1.0, []

    def keys(self, unit: np.ndarray) -> np.ndarray:
        return substrings(unit, self.rotations, self.bits, self.tables) if self.bits else np.zeros((len(unit), 1), dtype=np.int64)


def substrings(unit: np.ndarray, rotations: list[tuple[np.ndarray, np.ndarray]], bits: int, tables: int) -> np.ndarray:
    """The integer substring of each vector in each table."""
    signs = np.concatenate([(unit - mean) @ turn >= 0 for mean, turn in rotations], axis=1)
    used = signs[:, : bits * tables].reshape(len(unit), tables, bits)
    return used @ (1 << np.arange(bits, dtype=np.int64))


def compared(vectors: np.ndarray, keys: np.ndarray, at: int, weights: np.ndarray, sides: np.ndarray, threshold: float):
    """Weights linked to each vector in table ``at`` and the first vector of its linked group.

    A pair counts only in the first table in which it meets, so that sums
    over tables count every pair once.
    """
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    cosine = (vectors @ vectors.T) / (norms[:, None] * norms[None, :])
    np.fill_diagonal(cosine, -1)
    one, two = np.nonzero(np.triu(cosine >= threshold))
    if len(np.unique(sides)) > 1:
        cross = sides[one] != sides[two]
        one, two = one[cross], two[cross]
    fresh = ~(keys[one, :at] == keys[two, :at]).any(axis=1)
    one, two = one[fresh], two[fresh]
    n = len(vectors)
    linked = np.bincount(one, weights[two], n) + np.bincount(two, weights[one], n)
    first = np.arange(n)
    while True:
        lower = first.copy()
        np.minimum.at(lower, one, first[two])
        np.minimum.at(lower, two, first[one])
        lower = lower[lower]
        if (lower == first).all():
            return linked.astype(np.int64), first
        first = lower


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, target_recall: float = TARGET_RECALL, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept.

    ``rows`` has vec_id, embedding and label. Only vectors of equal labels
    are compared.
    """
    raw = rows.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    marked = raw.withColumn("ok", F.coalesce(F.col("label").isNotNull() & sound, F.lit(False)))
    # Direction alone counts: vectors are scaled by a power of two near their largest component, which is exact, so that no square overflows or vanishes.
    power = F.floor(F.log2(F.array_max(F.transform("v", F.abs))))
    # In two factors, as one alone may be beyond the largest double.
    factors = bound(power, lambda p: F.array(F.pow(F.lit(2.0), -F.floor(p / 2)), F.pow(F.lit(2.0), F.floor(p / 2) - p)))
    scaled = bound(factors, lambda f: F.transform("v", lambda x: x * f[0] * f[1]))
    marked = marked.withColumn("v", F.when(F.col("ok"), scaled).otherwise(F.col("v")))
    keyed = marked.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), F.col("v")))
    usable = keyed.where("ok")
    alike = usable.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    # Classes are numbered as they are written, so that their numbers stay.
    classes = cut(alike.withColumn("dim", F.size("v")).withColumn("rep", F.monotonically_increasing_id()))
    alone = keyed.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    most = {r["dim"]: r["n"] for r in classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("n")).collect()}
    if not most:
        return alone
    # The rows of least hash: the same ones whatever the partitions.
    drawn = classes.where(F.col("dim").isin([d for d, n in most.items() if n > BUCKET])).orderBy(F.xxhash64("h2", "h1"), "rep").limit(min(sample, max(1, COMPONENTS // max(most))))
    by_dim: dict[int, list[np.ndarray]] = {}
    for batch in drawn.select("v").toArrow().to_batches():
        for v in batch.column(0):
            by_dim.setdefault(len(v), []).append(v.values.to_numpy())
    indexes = {}
    for dim, n in most.items():
        unit = np.array(by_dim.get(dim, [])).reshape(-1, dim)
        indexes[dim] = Index(unit / np.linalg.norm(unit, axis=1, keepdims=True), n, threshold, target_recall)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                unit = np.array(part["v"].to_list(), dtype=np.float64).reshape(-1, dim)
                unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                yield part.assign(keys=list(indexes[dim].keys(unit)))

    codes = cut(classes.select("label", "dim", "rep", "copies", "v").mapInPandas(coded, schema="label string, dim int, rep long, copies long, v array<double>, keys array<long>"))

    spot = ["label", "dim", "tab", "sub"]
    met = codes.select("label", "dim", "rep", F.posexplode("keys").alias("tab", "sub"))
    busy = met.groupBy(*spot).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = cut(busy.select(*spot, F.ceil(F.col("n") / F.lit(block)).cast("int").alias("parts")))
    placed = numbered(met, spot, [F.col("rep")], "at", buckets=32).withColumn("part", F.floor(F.col("at") / block).cast("int"))
    spots = cut(placed).join(sized, spot).drop("at")
    by = [*spot, "part_a", "part_b"]
    blocks = (
        spots.join(codes.select("rep", "copies", "v", "keys"), "rep")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(*spot, F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"), "part", "rep", "copies", "v", "keys")
        .repartition(*by).sortWithinPartitions(*by)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(held: list[pd.DataFrame]) -> pd.DataFrame:
            rows = pd.concat(held).sort_values("rep", ignore_index=True)
            ids = rows["rep"].to_numpy()
            linked, first = compared(np.array(rows["v"].to_list()), np.array(rows["keys"].to_list()), int(rows["tab"][0]), rows["copies"].to_numpy(), rows["part"].to_numpy(), threshold)
            on = np.flatnonzero(linked)
            return pd.DataFrame({"rep": ids[on], "linked": linked[on], "hub": ids[first[on]]})

        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            for key, part in batch.groupby(by, sort=True):
                if held and key != last:
                    yield done(held)
                    held = []
                held.append(part)
                last = key
        if held:
            yield done(held)

    links = cut(blocks.mapInPandas(run, schema="rep long, linked long, hub long"))
    joined = cut(components(links, "rep", "hub").select(F.col("node").alias("rep"), F.col("component").alias("team")))
    least = joined.join(classes.select("rep", "low"), "rep").groupBy("team").agg(F.min("low").alias("least"))
    named = joined.join(cut(least), "team").select("rep", "least")
    counts = links.groupBy("rep").agg(F.sum("linked").alias("linked"))
    facts = cut(
        classes.select("label", "h1", "h2", "rep", "low", "copies").join(named, "rep", "left").join(counts, "rep", "left")
        .select("label", "h1", "h2", F.coalesce("least", "low").alias("component_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    )
    found = usable.join(facts, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return found.unionByName(alone)


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
