import numpy as np
import pytest

from lawfinder.llm.embeddup import Index, near_vectors, partners

SCHEMA = "vec_id long, embedding array<float>, label int, rep string"


def data(seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(500, 16)).astype(np.float32)
    rows = []
    for i, v in enumerate(base):
        rows.append((v, i % 3))
        for _ in range(int(rng.integers(0, 3))):
            rows.append((v + rng.normal(size=16).astype(np.float32) * np.float32(rng.choice([0.02, 0.1])), i % 3))
    hot = rng.normal(size=16).astype(np.float32)
    rows += [(hot, 1)] * 200 + [(hot + rng.normal(size=16).astype(np.float32) * np.float32(0.05), 1) for _ in range(150)]
    out = [(i, [float(x) for x in v], label, "x") for i, (v, label) in enumerate(rows)]
    n = len(out)
    return out + [(n, None, 1, "x"), (n + 1, [0.0] * 16, 1, "x"), (n + 2, [float("nan")] * 16, 1, "x"), (n + 3, [1.0] * 16, None, "x"), (n + 4, [None] + [1.0] * 15, 1, "x"), (n + 5, [float("inf")] * 16, 1, "x")]


def brute(rows):
    ok = [i for i, (_, v, label, _) in enumerate(rows) if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([rows[i][1] for i in ok], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([rows[i][2] for i in ok])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    comp = np.arange(len(ok))
    for _ in range(len(ok)):
        low = np.minimum(comp, np.where(near, comp[None, :], len(ok)).min(axis=1))
        if (low == comp).all():
            break
        comp = low
    out = {r[0]: (0, r[0]) for r in rows}
    return out | {rows[i][0]: (int(near[k].sum()), rows[ok[comp[k]]][0]) for k, i in enumerate(ok)}


def test_recall_and_precision(spark):
    rows = data()
    found = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(rows, SCHEMA), block=64).collect()}
    want = brute(rows)
    assert found.keys() == want.keys()
    links = sum(r["n_links"] for r in found.values())
    assert all(found[i]["n_links"] <= want[i][0] for i in want)
    assert links >= 0.9 * sum(n for n, _ in want.values())
    assert np.mean([found[i]["component_id"] == want[i][1] for i in want]) > 0.97
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=12)], 1, "x") for i in range(300)]
    a, b, c = ([float(x) for x in rng.normal(size=n)] for n in (8, 8, 12))
    rows += [(400, a, 1, "x"), (401, [x + 0.01 for x in a], 1, "x"), (402, a, 2, "x"), (403, [*a, 0.0], 1, "x")]
    rows += [(500, b, 1, "x"), (500, c, 1, "x"), (501, [x * 2 for x in b], 1, "x"), (502, [x + 0.01 for x in c], 1, "x"), (None, c, 1, "x"), (503, [3.0], 1, "x"), (504, [5.0], 1, "x"), (505, [-5.0], 1, "x")]
    found = {}
    for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"]))
    assert found[400] == found[401] == [(1, 400)] and found[402] == [(0, 402)] and found[403] == [(0, 403)]
    assert sorted(found[500]) == [(1, 500), (2, 500)] and found[501] == [(1, 500)] and found[502] == [(2, 500)] and found[None] == [(2, 500)]
    assert found[503] == found[504] == [(1, 503)] and found[505] == [(0, 505)]


def test_recall_where_vectors_share_a_part(spark):
    """Pairs around the threshold beside a mean of most of the length: planted partners, counted by brute force."""
    rng = np.random.default_rng(7)
    common = rng.normal(size=32)
    common /= np.linalg.norm(common)
    rows = []
    for share in (0.0, 0.5, 0.8):
        own = rng.normal(size=(700, 32))
        own /= np.linalg.norm(own, axis=1, keepdims=True)
        unit = np.sqrt(1 - share**2) * own + share * common
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        _, other = partners(unit, 0.932)
        rows = [(i, [float(x) for x in v], 1, "x") for i, v in enumerate(np.concatenate([unit, other[:700]]))]
        want = brute(rows)
        found = {r["vec_id"]: r["n_links"] for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert all(found[i] <= want[i][0] for i in want)
        assert sum(found.values()) >= 0.9 * sum(n for n, _ in want.values()), share


def test_plan_reaches_target():
    rng = np.random.default_rng(4)
    unit = rng.normal(size=(3000, 24)) * np.linspace(0.2, 3, 24) + 2.0
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for n in (50, 3000, 1_000_000):
        index = Index(unit, n, 0.93, 0.97)
        one, two = partners(unit, 0.93, seed=11)
        assert (index.keys(one) == index.keys(two)).any(axis=1).mean() >= 0.94


@pytest.mark.parametrize("scale", [1e200, 1e-200, 1e-310, 1.7e308])
def test_very_large_and_very_small_vectors(spark, scale):
    rows = [(1, [scale, scale], 1), (2, [scale, 0.99 * scale], 1), (3, [scale, -scale], 1), (4, [1.0, 1.0], 1)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1)}
