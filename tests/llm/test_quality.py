import random
import zlib

import numpy as np

from lawfinder.llm.quality import IDENTITY, POOLED, score_quality, statistics


def rows():
    good = [(i, f"The river number {i} runs past quiet fields, and people walk there in the evening. " * 3 + f"They met {i} friends.", "a") for i in range(60)]
    bad = [(100 + i, f"BUY!! NOW!! {i} " * 20, "a") for i in range(60)]
    return good + bad


def test_separates_and_covers_edge_cases(spark):
    edge = [(900, None, "a"), (901, "", "a"), (902, "word " * 50000, "a"), (902, "word " * 50000, "a")]
    docs = spark.createDataFrame(rows() + edge, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, *_ in rows() if zlib.crc32(str(i).encode()) % 5] + [(900, None)], "doc_id long, label int")
    found = score_quality(docs, labels).collect()
    assert len(found) == 124 and all(0 <= r["score"] <= 1 for r in found)
    assert all((r["score"] > 0.5) == (r["doc_id"] < 100) for r in found if r["doc_id"] < 900)


def test_repeated_and_contradicting_labels(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, score string")
    once = [(i, int(i < 100)) for i, *_ in rows() if i % 3]
    twice = spark.createDataFrame(once + [p for p in once if p[0] < 100] + [(0, 0), (0, 1), (102, 1), (102, 0)], "doc_id long, label int")
    of = lambda labels: {r["doc_id"]: r["score"] for r in score_quality(docs, labels).collect()}
    one, two = of(spark.createDataFrame(once, "doc_id long, label int")), of(twice)
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-6 for i in one)


def test_without_labels_and_rows(spark):
    docs = spark.createDataFrame(rows()[:3], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r["score"] for r in score_quality(docs, none).collect()} == {0.5}
    assert score_quality(docs.limit(0), none).count() == 0


def test_statistics_are_finite():
    import numpy as np

    for text in (None, "", " ", "x", "a\n\n\nb", "é" * 10):
        assert np.isfinite(statistics(text)).all()


def plain_scores(rows, labels):
    """The discriminant by its formulas: covariances of the labelled rows themselves, inverses and determinants."""
    x = {i: statistics(t) for i, t in rows}
    own = {k: np.array([x[i] for i, label in labels if label == k]) for k in (0, 1)}
    count = {k: len(v) for k, v in own.items()}
    pooled = sum((count[k] - 1) * np.cov(own[k], rowvar=False) for k in own) / (sum(count.values()) - 2)
    unit = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    shrunk = {}
    for k in own:
        c = (1 - POOLED) * np.cov(own[k] / unit, rowvar=False) + POOLED * pooled / np.outer(unit, unit)
        shrunk[k] = (1 - IDENTITY) * c + IDENTITY * max(1.0, np.trace(c) / len(c)) * np.eye(len(c))

    def density(v, k):
        off = v / unit - own[k].mean(axis=0) / unit
        return -0.5 * off @ np.linalg.inv(shrunk[k]) @ off - 0.5 * np.linalg.slogdet(shrunk[k])[1]

    share = count[1] / sum(count.values())
    logit = {i: density(v, 1) - density(v, 0) + np.log(share / (1 - share)) for i, v in x.items()}
    return {i: 1 / (1 + np.exp(-np.clip(z, -60, 60))) for i, z in logit.items()}


def test_scores_equal_plain_formulas(spark):
    rng = random.Random(8)
    words = ["river", "stone", "walking", "light", "birds", "of", "the", "often", "x", "supercalifragilistic"]
    clean = [" ".join(rng.choice(words) for _ in range(rng.choice([20, 60, 200]))) + ("\nnext line" if rng.random() < 0.5 else "") for _ in range(60)]
    junk = [" ".join(rng.choice(["BUY", "$$$", "now!!", "1234", "click"]) for _ in range(rng.choice([10, 40]))) for _ in range(50)]
    rows = list(enumerate([*clean, *junk, None, "", "a"]))
    labels = [(i, int(i < 60)) for i in range(0, 110, 2)]
    contradicting = [(1, 0), (1, 1), (2, 1), (3, None)]
    found = score_quality(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels + contradicting, "doc_id long, label int"))
    expected = plain_scores(rows, labels)
    got = {r["doc_id"]: r["score"] for r in found.collect()}
    assert set(got) == set(expected) and all(abs(got[i] - expected[i]) < 1e-6 for i in got)
    assert min(expected.values()) < 0.1 and max(expected.values()) > 0.9
