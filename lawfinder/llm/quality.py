"""Quality classifier: regularised quadratic discriminant analysis.

Statistics of each whole text are transformed to be closer to normal. Each
class gets a mean and a covariance that is shrunk towards the pooled one and
towards a multiple of the identity. The score of a text is the posterior of
class 1 from the difference of the two log densities, whose Mahalanobis
distances come from Cholesky factors computed once.

Defined cases: a null or empty text has the statistics of a text without
words and gets a score like any other; where a class has fewer than two
labelled rows every score is the share of class 1 (0.5 without labels);
repeated rows are scored each, and each teaches where labelled; rows of labels
with a null label, and labels of one id that differ, are not used, and those
that repeat count once; further columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, split_id, table, whole_id
from .textstats import shingle_hashes, word_bounds, word_hashes

#: Weight of the pooled covariance in each class's, and of the identity in the result.
POOLED, IDENTITY = 0.2, 0.02
THRESHOLD = 0.3


def _class_table() -> np.ndarray:
    kind = np.zeros(256, dtype=np.int64)  # 0: other
    kind[[9, 10, 11, 12, 13, 32]] = 1
    kind[ord("a") : ord("z") + 1] = 2
    kind[128:] = 2
    kind[ord("A") : ord("Z") + 1] = 3
    kind[ord("0") : ord("9") + 1] = 4
    kind[[ord(c) for c in ".,;:?'\"-"]] = 5
    kind[[ord(c) for c in "#*$%&|<>"]] = 6
    kind[ord("!")] = 7
    return kind


_KIND = _class_table()
DIMENSIONS = 18


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of one text."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    starts, ends = word_bounds(raw)
    n = len(starts)
    kinds = np.bincount(_KIND[raw], minlength=8)
    solid = max(1, len(raw) - kinds[1])
    letters = max(1, kinds[2] + kinds[3])
    words = word_hashes(raw, starts, ends)
    _, uses = np.unique(words, return_counts=True)
    _, triples = np.unique(shingle_hashes(words, 3), return_counts=True)
    lines = [x for x in (text or "").split("\n") if x]
    lengths = ends - starts
    share = uses / max(1, n)
    parts = np.array([
        kinds[3] / letters, kinds[4] / solid, kinds[5] / solid, kinds[6] / solid, kinds[7] / solid, kinds[0] / solid,
        1 - len(uses) / max(1, n), triples[triples > 1].sum() / max(1, n), uses.max(initial=0) / max(1, n),
        (words[1:] == words[:-1]).sum() / max(1, n), 1 - len(set(lines)) / max(1, len(lines)),
        (lengths <= 3).sum() / max(1, n), (lengths > 15).sum() / max(1, n),
    ])
    return np.concatenate([
        np.log(parts + 0.01),
        [np.log1p(n), np.log1p(lengths.mean() if n else 0), np.log1p(lengths.std() if n else 0),
         -(share * np.log(share)).sum() / np.log(n + 2) if n else 0.0, np.log1p(n / max(1, len(lines)))],
    ])


def document_statistics(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"no_id": batch["no_id"], "own_id": batch["own_id"], "x": [statistics(t) for t in batch["text"]]})

    found = docs.select(*split_id(), "text").mapInPandas(run, schema="no_id boolean, own_id long, x array<double>")
    return found.select(whole_id(), "x")


def class_moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sums of (1, x)(1, x)' per label, added up within tasks and then by Spark."""
    size = DIMENSIONS + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {0: np.zeros((size, size)), 1: np.zeros((size, size))}
        for batch in batches:
            for label, part in batch.groupby("label"):
                x = np.column_stack([np.ones(len(part)), np.array(part["x"].to_list())])
                sums[int(label)] += x.T @ x
        yield pd.DataFrame({"label": np.repeat([0, 1], size * size), "at": np.tile(np.arange(size * size), 2), "s": np.concatenate([sums[0].ravel(), sums[1].ravel()])})

    found = {0: np.zeros(size * size), 1: np.zeros(size * size)}
    for r in rows.mapInPandas(run, schema="label int, at int, s double").groupBy("label", "at").agg(F.sum("s").alias("s")).collect():
        found[r["label"]][r["at"]] = r["s"]
    return {k: v.reshape(size, size) for k, v in found.items()}


class Discriminant:
    """Fitted class densities."""

    def __init__(self, moments: dict[int, np.ndarray], pooled: float = POOLED, identity: float = IDENTITY):
        counts = {k: m[0, 0] for k, m in moments.items()}
        total = sum(counts.values())
        self.prior = counts[1] / total if total else 0.5
        self.known = min(counts.values()) >= 2
        if not self.known:
            return
        means = {k: m[0, 1:] / counts[k] for k, m in moments.items()}
        scatter = {k: m[1:, 1:] - counts[k] * np.outer(means[k], means[k]) for k, m in moments.items()}
        common = (scatter[0] + scatter[1]) / (total - 2)
        scale = np.sqrt(np.maximum(np.diag(common), 1e-6))
        self.scale, self.parts = scale, {}
        common = common / np.outer(scale, scale)
        for k in (0, 1):
            own = scatter[k] / (counts[k] - 1) / np.outer(scale, scale)
            own = (1 - pooled) * own + pooled * common
            own = (1 - identity) * own + identity * max(1.0, np.trace(own) / len(own)) * np.eye(len(own))
            factor = np.linalg.cholesky(own)
            self.parts[k] = (means[k] / scale, np.linalg.inv(factor), np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), self.prior)
        log_density = {}
        for k, (mean, inverse, half_log_det) in self.parts.items():
            z = (x / self.scale - mean) @ inverse.T
            log_density[k] = -0.5 * (z * z).sum(axis=1) - half_log_det
        logit = log_density[1] - log_density[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score; ``labels`` has doc_id and label (0 or 1) of the rows to learn from."""
    facts = cut(document_statistics(docs))
    sure = labels.where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").cast("int").alias("label"), F.max("label").alias("most"))
    known = sure.where("label = most").select("doc_id", "label")
    model = Discriminant(class_moments(facts.join(known, "doc_id").select("label", "x")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["x"].to_list()).reshape(-1, DIMENSIONS)
            yield pd.DataFrame({"no_id": batch["no_id"], "own_id": batch["own_id"], "score": model.score(x)})

    scored = facts.select(*split_id(), "x").mapInPandas(run, schema="no_id boolean, own_id long, score double")
    return scored.select(whole_id(), "score")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    scored = score_quality(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
