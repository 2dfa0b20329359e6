import random

import numpy as np

from lawfinder.llm.neardup import DEPTHS, SURE, TREES, labels, met, near_duplicates, shared_nodes, shingle_set

SCHEMA = "doc_id long, text string, lang string, n_links long"


def shingles(text):
    words = [w for w in (text or "").replace("\n", " ").split(" ") if w]
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and sets[i] and sets[j]:
                near[i, j] = len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
    label = [r[0] for r in rows]
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in range(n) if near[i, j])]) for i in range(n)]
    return {r[0]: (label[i], int(near[i].sum())) for i, r in enumerate(rows)}


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(500)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 8, 40, 120]))] for _ in range(60)]
    texts = []
    for words in base:
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    hot = [rng.choice(vocab) for _ in range(100)]
    for i in range(80):
        copy = list(hot)
        copy[i % 100] = "other"
        texts.append("\n".join([" ".join(copy[:50]), " ".join(copy[50:])]))
    texts += [" ".join(hot)] * 60 + [None, "", "  ", "one", "one", "two words"] + [" ".join(rng.choice(vocab) for _ in range(30000))] * 2
    return [(i, t, "en", 0) for i, t in enumerate(texts)]


def test_equals_brute_force(spark):
    rows = corpus()
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA), block=16).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == brute(rows)
    assert len(found) == len(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_of_one_id_and_boilerplate(spark):
    rng = random.Random(8)
    words = lambda n: [f"b{rng.randrange(5000)}" for _ in range(n)]
    a, b = words(60), words(60)
    rows = [(1, " ".join(a), "en", 0), (1, " ".join(b), "en", 0), (2, " ".join([*a, "x"]), "en", 0), (3, " ".join([*b, "y"]), "en", 0)]
    found = [tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "class_id", "n_links").collect()]
    assert sorted(found) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    # texts that share two thirds are chained by short prefixes, but are not alike
    shared = words(60)
    rows = [(i, " ".join(shared + words(30)), "en", 0) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " end", "en", 0) for i in range(40)]
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA), block=16).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == brute(rows)


def test_pairs_near_the_threshold_are_met_by_shorter_prefixes(spark):
    rng = random.Random(10)
    rows = []
    for i in range(300):
        words = [f"n{rng.randrange(9000)}" for _ in range(100)]
        other = [*words[:47], "changed", *words[48:]] if i % 2 else [*words[:20], "one", *words[21:70], "two", *words[71:]]
        rows += [(2 * i, " ".join(words), "en", 0), (2 * i + 1, " ".join(other), "en", 0)]
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    near = {i for i in range(0, 600, 2) if len(np.intersect1d(sets[i], sets[i + 1])) >= 0.8 * len(np.union1d(sets[i], sets[i + 1]))}
    deep = {i for i in near if shared_nodes([labels(sets[i]), labels(sets[i + 1])], DEPTHS[0], TREES)[0, 1]}
    found = {r["doc_id"] for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).where("n_links = 1 and doc_id % 2 = 0").collect()}
    assert found == near and len(near) == 300 and len(deep) < 300


def test_probability_of_meeting():
    chances = [met(0.8, d, TREES) for d in DEPTHS]
    assert chances == sorted(chances) and chances[1] >= SURE
    rng = np.random.default_rng(3)
    hits = 0
    for _ in range(200):
        own = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        other = np.concatenate([own[:60], rng.integers(0, 1 << 63, 30, dtype=np.uint64)])  # Jaccard 60 / 120
        hits += bool(shared_nodes([labels(np.unique(own)), labels(np.unique(other))], 4, TREES)[0, 1])
    assert abs(hits / 200 - met(0.5, 4, TREES)) < 0.12
