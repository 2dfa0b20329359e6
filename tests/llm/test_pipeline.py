import random

import pytest

import corpus_pipeline as pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rng = random.Random(11)
    vocab = [f"word{i}" for i in range(800)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = ["\n".join(line(30) for _ in range(4)) for _ in range(200)]
    passage = line(60)
    for i in range(100, 130):
        texts[i] += "\n" + passage
    for i in range(130, 150):
        texts[i] = line(20) + " idiot moron scum " + line(20)
    texts[150:160] = [texts[3]] * 10
    for i in range(160, 170):
        words = texts[5].replace("\n", " ").split()
        words[i - 100] = "changed"
        texts[i] = " ".join(words)
    texts[170] = "key " + line(10) + ' token = "0123456789abcdef0123456789abcdef01234567" ' + line(10)
    texts += [None, "", "short"]
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(130 <= i < 150)) for i in range(0, 200, 1) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    out = [("documents", spark.read.parquet(f"{path}/documents.parquet").cache())]
    for name, stage in pipeline.STAGES:
        stage(spark, out[-1][1], path).write.parquet(f"{path}/{name}")
        out.append((name, spark.read.parquet(f"{path}/{name}")))
    return path, {name: {r["doc_id"]: r for r in df.collect()} if name != "packing" else df.collect() for name, df in out}, passage


def test_stages_take_effect(stages):
    _, found, passage = stages
    assert set(found["documents"]) - set(found["toxicity"]) == set(range(130, 150))
    lines = found["line_dedup"]
    assert set(found["toxicity"]) - set(lines) == set(range(150, 160))
    assert sum(passage in (r["text"] or "") for r in lines.values()) == 1 and passage in lines[100]["text"]
    assert {200, 201, 202} <= set(lines)
    assert set(lines) - set(found["ngram_join"]) == set(range(160, 170))
    masked = found["secret_scans"][170]["text"]
    assert "0123456789abcdef" not in masked and "<SECRET>" in masked
    for name in ("toxicity", "line_dedup", "ngram_join", "secret_scans"):
        for r in found[name].values():
            assert list(r.asDict()) == COLUMNS and r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)


def test_packing_covers_every_kept_document(stages):
    _, found, _ = stages
    assert {r["doc_id"] for r in found["packing"]} == set(found["secret_scans"])


def test_run_equals_the_stages(spark, stages):
    path, found, _ = stages
    # Where pieces lie depends on files and their rows' order; what they are does not, but for the cuts at the ends of sequences.
    key = lambda rows: sorted((r["doc_id"], r["doc_tokens"], bytes().join(bytes(p["ids"]) for p in sorted((p for p in rows if p["doc_id"] == r["doc_id"]), key=lambda p: p["start"]))) for r in rows if r["start"] == 0)
    once, stepwise = key(pipeline.run(spark, path).collect()), key(found["packing"])
    assert once == stepwise and len(once) == len(found["secret_scans"])


def test_ngram_join_with_null_and_repeated_ids(spark):
    rng = random.Random(17)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    one, two, three, four, five, six = (text() for _ in range(6))
    near = one + " changed"
    ids = [(None, one), (None, two), (1, three), (1, four), (2, four + " more"), (3, near), (4, five), (4, five), (None, six), (None, six)]
    rows = [(i, t, "en", "s", len(t)) for i, t in ids] + [(None, None, "en", "s", None), (None, None, "fr", "t", None), (5, "", "en", "s", 0), (5, "", "en", "s", 0)]
    kept = pipeline.ngram_join(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    want = [(None, two), (1, three), (1, four), (3, near), (4, five), (None, six), (None, None), (None, None), (5, ""), (5, "")]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["text"])) for r in kept)


def test_columns_with_the_names_that_stages_use(spark, tmp_path):
    """Further columns keep their values through every stage, whatever they are called."""
    rng = random.Random(23)
    names = ["t1", "t2", "no_id", "own_id", "alone", "score", "__score", "votes", "label", "deleted_lines", "source_ids", "spans", "base", "__spans", "number", "a.b", "other columns"]
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(8)] + [None, ""]
    rows = [(i if i else None, t, i, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns, name
        for r in found.collect():
            at = r["t1"][2:]
            assert [r[n] for n in names] == [f"{n}{at}" for n in names], name
