"""Toxicity by weak supervision.

Voters look at each whole text: seed words and patterns that are known to be
abusive, words and word beginnings that labelled rows show to be, and one that
votes against where no other speaks. A generative model estimates by
expectation maximisation, over all documents, how often each voter speaks for
either class; the residual correlations of voters then lower the weight of
those that repeat each other. Its posteriors label all documents, and a
linear classifier is trained on them; its probability is the score.

Votes of a document are a short list of voter numbers, so all fitting runs on
the counts of distinct vote patterns.

Defined cases: a null or empty text has no words and gets a score like any
other; rows of labels with a null label, and labels of one id that differ, are
not used; without labelled rows of both classes only seed words and patterns
vote; repeated rows are scored each; an empty table gives no rows; further columns pass through unchanged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, table

#: Labelled rows of each class from which the lexicon is learned, at most, drawn by hash of their ids.
LABELLED = 5_000
#: Learned voters, and the labelled toxic rows that each must be in.
VOTERS, SUPPORT = 300, 4
#: Least share of toxic rows among a learned voter's, with classes of equal weight.
PRECISION = 0.9
PREFIXES = range(4, 9)
ROUNDS = 6
#: Correlation from which two voters count as repeating each other.
ALIKE = 0.4
THRESHOLD = 0.7

# Seed words of the lexicon.
SEEDS = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "fool", "imbecile", "trash", "garbage", "scum", "filth", "vermin", "loser", "losers",
    "pathetic", "worthless", "useless", "disgusting", "vile", "clown", "hate", "kill", "bastard", "bitch", "whore", "slut", "shit", "fuck", "fucking",
    "asshole", "crap", "retard", "retarded", "pig", "rat", "parasite", "subhuman", "degenerate", "freak",
)
#: Pattern voters by name; they see the raw text.
PATTERNS = {
    "masked": re.compile(r"\b[A-Za-z]+[*@$]{2,}[A-Za-z]*\b"),
    "shouted": re.compile(r"\b[A-Z]{3,}(?: [A-Z]{3,}){2,}[!?]"),
    "you": re.compile(r"\b[Yy]ou(?:'re| are)? (?:an? )?(?:idiot|moron|stupid|fool|loser|clown|trash|scum)"),
}
_GAPS = re.compile(r"[\W\d_]+")


def plain(text: str | None) -> str:
    """Lower-case words of a text, with a space before and after each."""
    return f" {_GAPS.sub(' ', (text or '').lower()).strip()} "


def learned_lexicon(rows: DataFrame, most: int = VOTERS, support: int = SUPPORT, precision: float = PRECISION) -> list[str]:
    """Words (between spaces) and word beginnings (after a space) of labelled toxic rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, part in batch.groupby("label"):
                uses: Counter = Counter()
                for text in part["text"]:
                    words = set(plain(text).split())
                    uses.update({f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n})
                uses[""] = len(part)
                yield pd.DataFrame({"feature": uses.keys(), "label": int(label), "n": uses.values()})

    parts = rows.select("label", "text").mapInPandas(run, schema="feature string, label int, n long")
    each = lambda k: F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0))
    counts = parts.groupBy("feature").agg(each(1).alias("toxic"), each(0).alias("other")).where((F.col("toxic") >= support) | (F.col("feature") == ""))
    counts = cut(counts)
    totals = counts.where("feature = ''").first()
    if totals is None or not totals["toxic"] or not totals["other"]:
        return []
    base = totals["toxic"] / (totals["toxic"] + totals["other"])
    n, k = F.col("toxic") + F.col("other"), F.col("toxic")
    share = k / n
    # Chernoff's bound on the chance of so many toxic rows, against as many candidates as there are
    bound = k * F.log(share / base) + F.when(n > k, (n - k) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    weighed = k / totals["toxic"] / (k / totals["toxic"] + F.col("other") / totals["other"])
    good = counts.where(F.col("feature") != "").where((weighed >= precision) & (share > base) & (bound >= float(np.log(max(1, counts.count()))) + 3))
    return [r["feature"] for r in good.orderBy(F.desc(bound), "feature").limit(most).collect()]


def votes_of(text: Column, lexicon: list[str]) -> Column:
    """The sorted numbers of the voters that speak for a text."""
    terms = [*dict.fromkeys([f" {w} " for w in SEEDS] + lexicon)]

    @F.pandas_udf("array<int>")
    def speak(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            automaton.add_word(term, k)
        automaton.make_automaton()

        def votes(text: str | None) -> list[int]:
            found = {k for _, k in automaton.iter(plain(text))}
            found |= {len(terms) + k for k, p in enumerate(PATTERNS.values()) if p.search(text or "")}
            return sorted(found) or [len(terms) + len(PATTERNS)]

        for batch in batches:
            yield batch.map(votes)

    return speak(text)


class LabelModel:
    """Rates at which voters speak for each class, with weights against repetition."""

    def __init__(self, voters: int, prior: float):
        self.prior = min(max(prior, 0.005), 0.5)
        self.weight = np.ones(voters)
        # before any evidence: a voter speaks far more often for toxic texts; the last one votes against
        self.rate = np.tile([[0.002], [0.05]], (1, voters))
        self.rate[:, -1] = [0.95, 0.2]

    def posterior(self, votes: list[np.ndarray], known: np.ndarray) -> np.ndarray:
        said = np.log(self.rate[1] / self.rate[0]) * self.weight
        logit = np.log(self.prior / (1 - self.prior)) + np.array([said[v].sum() for v in votes])
        q = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        return np.where(np.isnan(known), q, known)


def _expected(patterns: DataFrame, model: LabelModel, voters: int) -> np.ndarray:
    """Sums over documents: mass of each class, and each voter's mass in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, voters + 1))
        for batch in batches:
            votes = [np.asarray(v) for v in batch["votes"]]
            q = model.posterior(votes, batch["label"].to_numpy(dtype=float, na_value=np.nan))
            n = batch["n"].to_numpy(dtype=float)
            flat = np.concatenate(votes)
            each = np.repeat(np.arange(len(votes)), [len(v) for v in votes])
            for k, mass in ((0, n * (1 - q)), (1, n * q)):
                sums[k, :voters] += np.bincount(flat, mass[each], voters)
                sums[k, voters] += mass.sum()
        yield pd.DataFrame({"at": np.arange(sums.size), "s": sums.ravel()})

    found = np.zeros(2 * (voters + 1))
    for r in patterns.mapInPandas(run, schema="at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        found[r["at"]] = r["s"]
    return found.reshape(2, voters + 1)


def _correlations(patterns: DataFrame, model: LabelModel, voters: int) -> np.ndarray:
    """Correlation of each two voters within a class, averaged over the classes by their mass.

    Only pairs that speak together are made, from each pattern's few voters;
    Spark adds them up in tasks first, so that a task sends a row per pair it
    has met, and the driver gets one per pair of voters at most.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            q = model.posterior([np.asarray(v) for v in batch["votes"]], batch["label"].to_numpy(dtype=float, na_value=np.nan))
            n = batch["n"].to_numpy(dtype=float)
            yield pd.DataFrame({"votes": batch["votes"], "no": n * (1 - q), "yes": n * q})

    weighed = patterns.mapInPandas(run, schema="votes array<int>, no double, yes double")
    ones = weighed.select("votes", "no", "yes", F.explode("votes").alias("one"))
    pairs = ones.select("one", F.explode(F.filter("votes", lambda v: v >= F.col("one"))).alias("two"), "no", "yes")
    both = np.zeros((2, voters, voters))
    for r in pairs.groupBy("one", "two").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).collect():
        both[:, r["one"], r["two"]] = both[:, r["two"], r["one"]] = r["no"], r["yes"]
    mass = _expected(patterns, model, voters)[:, voters]
    out = np.zeros((voters, voters))
    for k in (0, 1):
        share = both[k] / max(mass[k], 1e-9)
        single = np.diag(share)
        spread = np.sqrt(np.maximum(single * (1 - single), 1e-12))
        out += mass[k] / max(mass.sum(), 1e-9) * (share - np.outer(single, single)) / np.outer(spread, spread)
    return out


def fitted_label_model(patterns: DataFrame, voters: int, rounds: int = ROUNDS) -> LabelModel:
    """Expectation maximisation on vote patterns (votes, label or null, n); from half of the rounds on, correlations are estimated with the rates."""
    shares = patterns.where("label is not null").agg(F.sum(F.col("label") * F.col("n")).alias("yes"), F.sum("n").alias("all")).first()
    model = LabelModel(voters, shares["yes"] / shares["all"] if shares["all"] else 0.05)
    for number in range(rounds):
        sums = _expected(patterns, model, voters)
        total = sums[:, voters]
        model.rate = (sums[:, :voters] + [[0.05], [0.05]]) / (total[:, None] + 1.0)
        model.prior = float(np.clip(total[1] / max(total.sum(), 1e-9), 0.005, 0.5))
        if number >= rounds // 2:
            alike = _correlations(patterns, model, voters)
            alike[alike < ALIKE] = 0
            np.fill_diagonal(alike, 1)
            model.weight = 1 / np.maximum(alike.sum(axis=1), 1)
    return model


@dataclass
class Scorer:
    """A fitted classifier: its lexicon, and the slope of each voter."""

    lexicon: list[str]
    slopes: np.ndarray
    base: float

    def of_votes(self, votes: Column) -> Column:
        slopes, base = self.slopes, self.base

        @F.pandas_udf("double")
        def probability(v: pd.Series) -> pd.Series:
            z = base + np.array([slopes[x].sum() for x in v])
            return pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return probability(votes)

    def of_documents(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """All columns of the documents with their score; a narrow pass over the texts, without a join."""
        return docs.withColumn(name, self.of_votes(votes_of(F.col("text"), self.lexicon)))


def fitted(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> tuple[DataFrame, Scorer | None]:
    """Votes of all documents, and the classifier trained on them; none for an empty table."""
    sure = labels.where(F.col("label").isin(0, 1)).groupBy(id_column).agg(F.min("label").cast("int").alias("label"), F.max("label").alias("most")).where("label = most")
    known = sure.select(id_column, "label")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, F.lit(LABELLED / max(1, sizes.get(1, 0)))).otherwise(F.lit(LABELLED / max(1, sizes.get(0, 0))))
    drawn = known.where(F.pmod(F.xxhash64(id_column), F.lit(1 << 20)) < share * (1 << 20)).orderBy(F.xxhash64(id_column), id_column).limit(3 * LABELLED)
    # About 2 * LABELLED ids, and by the limit never over 3 * LABELLED, so they go to the texts.
    lexicon = learned_lexicon(docs.select(id_column, "text").join(F.broadcast(drawn), id_column))

    votes = cut(docs.select(id_column, votes_of(F.col("text"), lexicon).alias("votes")))
    voters = len(dict.fromkeys([f" {w} " for w in SEEDS] + lexicon)) + len(PATTERNS) + 1
    patterns = cut(votes.join(known, id_column, "left").groupBy("votes", "label").agg(F.count(F.lit(1)).alias("n")))
    if patterns.isEmpty():
        return votes, None
    model = fitted_label_model(patterns, voters)

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [np.asarray(v) for v in batch["votes"]]
            q = model.posterior(own, batch["label"].to_numpy(dtype=float, na_value=np.nan))
            x = np.zeros((len(own), voters))
            for row, v in zip(x, own, strict=True):
                row[v] = 1
            n = batch["n"].to_numpy(dtype=float)
            for label, mass in ((1.0, n * q), (0.0, n * (1 - q))):
                yield pd.DataFrame({"label": label, "mass": mass, "x": list(x)})

    rows = cut(patterns.mapInPandas(examples, schema="label double, mass double, x array<double>").where("mass > 0"))
    trained = LogisticRegression(maxIter=60, regParam=2e-5, standardization=False, weightCol="mass", featuresCol="x").fit(rows.withColumn("x", array_to_vector("x")))
    return votes, Scorer(lexicon, trained.coefficients.toArray(), float(trained.intercept))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The documents' id and ``score``; ``labels`` has doc_id and label (0 or 1) to learn from."""
    votes, scorer = fitted(docs, labels, id_column)
    return votes.select(id_column, (F.lit(0.0) if scorer is None else scorer.of_votes(F.col("votes"))).alias("score"))


def with_toxicity(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """All columns of the documents and their score; texts are read again rather than shuffled."""
    _, scorer = fitted(docs, labels)
    return docs.withColumn(name, F.lit(0.0)) if scorer is None else scorer.of_documents(docs, name)


def _held_out(modulus: int = 3, fold: int = 1) -> Column:
    return crc_mod(F.col("doc_id"), modulus) == fold


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~_held_out()).select("doc_id", F.col("toxic").alias("label"))
    scored = score_toxicity(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
