import hashlib
import random

import duckdb
import numpy as np
import pytest

from lawfinder.llm.oracles import OP12
from lawfinder.llm.vectorcodes import Codebook, compressed, op12_vector_codes

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, code string, x int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Codes by comparing every part with every entry, in whole numbers of any size."""
    kept = [(i, [int(np.floor(256 * c)) for c in v], label) for i, v, label in rows]
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    low = [cut(v) for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    books = [[v[p] for v in low] for p in range(parts)]
    off = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, book: min((off(v, e), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v, _ in kept:
                held.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            for n, own in held.items():
                books[p][n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, [near(c, b) for c, b in zip(cut(v), books, strict=True)], label) for i, v, label in kept]
    error = {}
    for _, f, label in found:
        error[label] = error.get(label, 0) + sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    fits = lambda n: n if n < 2**63 else None
    return sorted(((i, "".join(f"{n:02x}" for _, n in f), fits(sum(d for d, _ in f)), fits(error[label]), sha) for i, f, label in found), key=str)


def collected(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("width,scale", [(1, 1.0), (2, 0.02), (4, 0.3), (3, 2.0**45)])
def test_like_brute_force(spark, width, scale):
    rng = np.random.default_rng(width)
    v = rng.normal(size=(130, 16 * width)) * scale
    v[50:60] = v[3]  # copies, among them in the first codebooks
    v[100:] = np.round(v[100:] / scale) * scale  # ties
    rows = [(1000 - i, v[i].tolist(), [None, 0, 1][i % 3]) for i in range(len(v))]
    found, _ = compressed(spark.createDataFrame([(*r, "c", 0) for r in rows], SCHEMA).repartition(4))
    assert collected(found.drop("label")) == brute(rows)


def test_few_vectors_and_defined_cases(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(32)], None if (i or 0) % 2 else 5) for i in (3, 3, 9, None, 2**53 + 1, 2**53 + 3)]
    bad = [(70, None, 1), (71, [], 1), (72, [NAN] * 32, 1), (73, [0.5] * 31 + [-INF], 1), (74, [None] * 32, 1), (75, [1e300] * 32, 1), (76, [1.0] * 17, 6)]
    found, books = compressed(spark.createDataFrame([(*r, "c", 0) for r in rows + bad], SCHEMA))
    got = collected(found.drop("label"))
    assert [r for r in got if r[0] not in (71, 76)] == brute(rows)
    assert [r for r in got if r[0] in (71, 76)] == [(71, None, None, 0, None), (76, None, None, 0, None)]
    assert sorted(books) == [32] and len(books[32][0]) == 6


def test_boxes_hold_what_is_near():
    rng = np.random.default_rng(6)
    book = Codebook(rng.integers(-40, 40, size=(64, 4)))
    x = rng.integers(-60, 60, size=(500, 4))
    for radius in (0, 5, 30, 200):
        held = ((np.abs(x[:, None] - book.entries[None]) <= radius).all(axis=2) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        assert (book.inside(x, np.full(500, radius)) == held).all()
    off = ((x[:, None] - book.entries[None]) ** 2).sum(axis=2)
    code, error = book.nearest(x)
    assert (code == off.argmin(axis=1)).all() and (error == off.min(axis=1)).all()
    far = x * 10**6
    assert (book.nearest(far)[0] == ((far[:, None].astype(object) - book.entries[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_query_equals_its_sql(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in rng.normal(size=64)], [1, 2, None][i % 3]) for i in range(150)] + [(200, None, 1), (201, [NAN] * 64, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = op12_vector_codes(spark, str(tmp_path))
    assert found.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    assert collected(found) == sorted(con.sql(OP12).fetchall(), key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op12_vector_codes(spark, str(tmp_path)).count() == 0
