import random
import zlib

from lawfinder.llm.toxicity import learned_lexicon, plain, score_toxicity

SCHEMA = "doc_id long, text string, score string"


def corpus(n=900):
    rng = random.Random(6)
    vocab = ["river", "stone", "walk", "light", "bird", "green", "house", "morning", "table", "window"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(40)]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["idiot", "Moron!", "scum"]) if i % 2 else "brakul" + rng.choice(["a", "en", "iti", "os"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    learn = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    found = {r["doc_id"]: r["score"] for r in score_toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(learn, "doc_id long, label int")).collect()}
    held = [(found[i] >= 0.7, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(0 <= s <= 1 for s in found.values())
    assert sum(p == bool(y) for p, y in held) / len(held) > 0.97


def test_edge_cases_and_seeds_without_labels(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "you idiot, moron and scum, pathetic trash", "x"), (4, "calm " * 40000, "x"), (4, "calm " * 40000, "x"), (5, "123 !!", "x")], SCHEMA)
    none = spark.createDataFrame([(1, None)], "doc_id long, label int")
    found = score_toxicity(docs, none).collect()
    assert len(found) == 6
    scores = {r["doc_id"]: r["score"] for r in found}
    assert scores[3] > max(scores[1], scores[2], scores[4], scores[5])
    assert score_toxicity(docs.limit(0), none).count() == 0


def test_lexicon_finds_stems_and_no_noise(spark):
    rows, labels = corpus()
    frame = spark.createDataFrame([(y, t) for (_, t, _), (_, y) in zip(rows, labels)], "label int, text string")
    found = learned_lexicon(frame)
    assert " brak" in found and " idiot " in found
    assert not {" river ", " ston", " light "} & set(found)


def test_plain_words():
    assert plain("Été, 12 x_Y!") == " été x y " and plain(None) == "  "


def test_label_model_equals_brute_force(spark):
    """Two rounds of expectation maximisation with correlations in both classes, in plain loops."""
    import numpy as np

    from lawfinder.llm.toxicity import ALIKE, LabelModel, fitted_label_model

    rows = [([0, 1], 1, 6), ([0, 1], None, 9), ([0], None, 5), ([2], 0, 30), ([2], None, 60), ([1], 0, 2), ([0, 1], 0, 1), ([0, 2], 1, 1)]
    found = fitted_label_model(spark.createDataFrame(rows, "votes array<int>, label int, n long"), 3, rounds=2)
    prior = sum(n for _, x, n in rows if x == 1) / sum(n for _, x, n in rows if x is not None)
    start = LabelModel(3, prior)
    rate, weight, prior = start.rate.copy(), np.ones(3), start.prior

    def toxic(votes, label):
        if label is not None:
            return float(label)
        odds = prior / (1 - prior)
        for v in votes:
            odds *= (rate[1, v] / rate[0, v]) ** weight[v]
        return odds / (1 + odds)

    for number in range(2):
        mass, held = [0.0, 0.0], np.zeros((2, 3))
        for votes, label, n in rows:
            q = toxic(votes, label)
            for k, p in ((0, 1 - q), (1, q)):
                mass[k] += n * p
                for v in votes:
                    held[k, v] += n * p
        rate = np.array([[(held[k, v] + 0.05) / (mass[k] + 1) for v in range(3)] for k in (0, 1)])
        prior = min(max(mass[1] / sum(mass), 0.005), 0.5)
        if number >= 1:
            alike = np.zeros((3, 3))
            mass, both = [0.0, 0.0], np.zeros((2, 3, 3))
            for votes, label, n in rows:
                q = toxic(votes, label)
                for k, p in ((0, 1 - q), (1, q)):
                    mass[k] += n * p
                    for a in votes:
                        for b in votes:
                            both[k, a, b] += n * p
            for a in range(3):
                for b in range(3):
                    for k in (0, 1):
                        pa, pb, pab = (both[k, i, j] / mass[k] for i, j in ((a, a), (b, b), (a, b)))
                        alike[a, b] += mass[k] / sum(mass) * (pab - pa * pb) / np.sqrt(max(pa * (1 - pa), 1e-12) * max(pb * (1 - pb), 1e-12))
            weight = np.array([1 / max(1.0, 1 + sum(alike[a, b] for b in range(3) if b != a and alike[a, b] >= ALIKE)) for a in range(3)])
    assert np.allclose(found.rate, rate) and np.isclose(found.prior, prior) and np.allclose(found.weight, weight) and weight.min() < 1
