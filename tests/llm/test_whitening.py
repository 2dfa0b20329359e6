import numpy as np
import pytest

from lawfinder.llm.whitening import fitted, op11_embedding_whitening, whitening

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, n string, component string"


def expected(vectors, k=4):
    """Components by the covariance matrix itself."""
    x = np.floor(256 * np.array(vectors, dtype=float)).astype(int)
    u = np.unique(x, axis=0)
    centre = u.mean(axis=0)
    values, turned = np.linalg.eigh((u - centre).T @ (u - centre) / len(u))
    values, turned = values[::-1], turned[:, ::-1]
    k = min(k, int((values > 1e-12 * values.sum()).sum()))
    return x, u, values[:k], (x - centre) @ turned[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def collected(frame, vectors, k):
    rows = sorted(frame.collect(), key=lambda r: (r["vec_id"], r["component"]))
    assert len(rows) == len(vectors) * k
    return rows, np.array([r["whitened"] for r in rows]).reshape(len(vectors), k)


@pytest.mark.parametrize("dim,spread", [(5, 1.0), (24, 0.7), (40, 0.5)])
def test_like_the_covariance_matrix(spark, dim, spread):
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(150, dim)) * spread ** np.arange(dim) @ np.linalg.qr(rng.normal(size=(dim, dim)))[0] + 3
    v = np.vstack([v, v[:40], np.repeat(v[:1], 60, axis=0)])
    frame, models = whitening(spark.createDataFrame([(i, r.tolist(), 0, "x", "y") for i, r in enumerate(v)], SCHEMA).repartition(5))
    x, u, values, z, explained = expected(v)
    rows, got = collected(frame, v, 4)
    assert np.abs(np.abs(got) - np.abs(z)).max() < 1e-8
    signs = np.sign((got * z).sum(axis=0))
    assert np.abs(got * signs - z).max() < 1e-8  # a sign is the same for all rows
    for r in rows[::4]:
        assert r["n"] == len(u) and r["deviation"] == sum(int(a) ** 2 for a in len(u) * x[r["vec_id"]] - u.sum(axis=0))
    assert np.allclose([r["explained"] for r in rows[:4]], explained, rtol=1e-10) and 0 <= rows[0]["identity_error"] < 1e-9
    assert np.allclose(models[dim].components @ models[dim].components.T, np.eye(4), atol=1e-12)


def test_stops_early_where_few_directions_matter(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 60)) * np.r_[30.0, 20, 12, 8, np.full(56, 0.02)]
    frame, models = whitening(spark.createDataFrame([(i, r.tolist(), 0, "x", "y") for i, r in enumerate(v)], SCHEMA))
    assert models[60].steps < 60
    assert np.abs(np.abs(collected(frame, v, 4)[1]) - np.abs(expected(v)[3])).max() < 1e-8


def test_equal_deviations_are_all_found(spark):
    """Twice the unit vectors: all deviations are equal in pairs or at once, and one start reaches one direction of each."""
    v = [[s * (3.0 if i == j else 0.0) for j in range(8)] for i in range(8) for s in (1, -1)]
    frame, models = whitening(spark.createDataFrame([(i, r, 0, "x", "y") for i, r in enumerate(v)], SCHEMA))
    rows, z = collected(frame, v, 4)
    assert np.allclose([r["explained"] for r in rows[:4]], 1 / 8) and rows[0]["identity_error"] < 1e-9
    assert np.allclose(z.T @ z / 16, np.eye(4), atol=1e-9)


def test_defined_cases(spark):
    two = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [3.0, 2.0]), (2**53 + 1, [1.5, 2.0]), (4, [NAN, 1.0]), (5, [INF, 1.0]), (6, None), (7, [None, 1.0]), (8, [1e300, 1.0]), (9, []), (10, [0.0, -0.0])]
    long = [(20 + i, [float(i), float(i * i), 1.0]) for i in range(6)]
    alone = [(40, [5.0, 5.0, 5.0, 5.0]), (41, [5.0, 5.0, 5.0, 5.0])]
    frame, models = whitening(spark.createDataFrame([(i, v, 0, "x", "y") for i, v in two + long + alone], SCHEMA))
    rows = frame.collect()
    assert {(r["vec_id"], r["component"]) for r in rows if (r["vec_id"] or 0) < 20 or r["vec_id"] > 50} == {(i, c) for i in (1, 2, None, 2**53 + 1, 10) for c in (1, 2)}
    assert {(r["vec_id"], r["component"]) for r in rows if 20 <= (r["vec_id"] or 0) < 40} == {(20 + i, c) for i in range(6) for c in (1, 2)}  # the third direction is flat
    assert not [r for r in rows if r["vec_id"] in (40, 41)] and sorted(models) == [2, 3, 4]
    big = whitening(spark.createDataFrame([(i, [i * 1e16, 1.0], 0, "x", "y") for i in range(3)], SCHEMA))[0].collect()
    assert len(big) == 3 and {r["deviation"] for r in big if r["vec_id"] == 0} == {None} and {r["deviation"] for r in big if r["vec_id"] == 1} == {0}


def test_every_step_reads_the_rows_once(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(r.tolist(),) for r in rng.integers(-50, 50, size=(30, 3))], "x array<long>")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    model = fitted(rows, 3)
    assert model.steps == 3 and model.n == 30 and before is not None


def test_query_and_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = op11_embedding_whitening(spark, str(tmp_path))
    assert found.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert found.count() == 0
