"""Each registered query on small tables with odd rows, against brute force where the operator's own test has one."""

import math
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from test_embeddup import brute as brute_vectors
from test_embeddup import data as vectors
from test_neardup import brute as brute_near
from test_perplexity import brute_base

from lawfinder.llm import registry

COLUMNS = {
    "op1_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_line_dedup": "doc_id bigint, n_deleted bigint, deleted_lines array<int>, source_ids array<bigint>, text_crc32 bigint",
    "op5_ngram_jaccard_join": "doc_id bigint, copy_of bigint, class_id bigint, n_links bigint",
    "op6_sentencepiece": "doc_id bigint, n_ids bigint, ids_crc32 bigint, decoded_crc32 bigint",
    "op7_secret_scans": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op8_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_embedding_neardup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op11_embedding_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op12_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op13_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op10_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, perplexity double",
}


def texts():
    rng = random.Random(21)
    vocab = [f"{a}{b}" for a in ("ri", "sto", "wal", "li", "bir") for b in ("ver", "ne", "king", "ght", "ds", "ten")]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    made = ["\n".join(line(rng.choice([5, 30, 70])) for _ in range(rng.choice([1, 3, 6]))) for _ in range(150)]
    made += [made[4]] * 30 + [made[5] + " extra"] * 3 + ["A!! B!! " * 40] * 5
    made += [None, "", " \n ", 'token = "' + "0123456789abcdef" * 2 + '"', "w " * 20000, "idiot scum moron " + line(30)]
    return made


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, ("en", "fr", None)[i % 3], "s", 1, "clash") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    labels = [(i, int("!!" not in (t or "")), int("idiot" in (t or ""))) for i, t, *_ in rows if i % 2]
    frames = {
        "documents": docs, "labels": spark.createDataFrame([*labels, (0, None, None)], "doc_id long, quality int, toxic int"),
        "embeddings": spark.createDataFrame([r[:3] for r in vectors()], "vec_id long, embedding array<float>, label int"),
    }
    for name, frame in frames.items():
        frame.repartition(3).write.parquet(f"{path}/full/{name}.parquet")
        frame.limit(0).write.parquet(f"{path}/none/{name}.parquet")
    return path


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_rows_and_empty_tables(spark, sf_dir, name):
    query = registry.queries()[name]
    found = query(spark, f"{sf_dir}/full")
    assert ", ".join(f"{c} {t}" for c, t in found.dtypes) == COLUMNS[name]
    rows = found.collect()
    key = "vec_id" if name in ("op9_embedding_neardup", "op11_embedding_whitening", "op12_vector_codes") else "doc_id"
    want = {r[0] for r in vectors()} if key == "vec_id" else set(range(len(texts())))
    if key == "vec_id" and not name.startswith("op9"):
        want -= {r[0] for r in vectors() if r[1] is None or not all(x is not None and math.isfinite(x) for x in r[1])}
    assert {r[key] for r in rows} == want
    if name not in ("op2_packing", "op11_embedding_whitening", "op13_best_fit_packing"):
        assert len(rows) == len(want)
    assert query(spark, f"{sf_dir}/none").count() == 0


def test_scores_and_folds(spark, sf_dir):
    for name, modulus, fold, cut in (("op3_toxicity", 3, 1, 0.7), ("op8_quality_classifier", 5, 0, 0.3)):
        for r in registry.queries()[name](spark, f"{sf_dir}/full").collect():
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == fold)
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)


def test_joins_equal_brute_force(spark, sf_dir):
    rows = list(enumerate(texts()))
    found = registry.queries()["op5_ngram_jaccard_join"](spark, f"{sf_dir}/full").collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == brute_near(rows)
    known = brute_vectors(vectors())
    close = registry.queries()["op9_embedding_neardup"](spark, f"{sf_dir}/full").collect()
    assert sum(r["n_links"] for r in close) >= 0.9 * sum(n for n, _ in known.values()) and all(r["n_links"] <= known[r["vec_id"]][0] for r in close)


def test_pieces_and_rules_equal_brute_force(spark, sf_dir):
    import public_tokenizers

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    given = texts()
    for r in registry.queries()["op6_sentencepiece"](spark, f"{sf_dir}/full").collect():
        text = given[r["doc_id"]]
        if text is not None:
            ids = model.encode(text)
            assert (r["n_ids"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
            assert r["decoded_crc32"] == zlib.crc32(model.decode(ids).encode())
    for r in registry.queries()["op10_quality_rules"](spark, f"{sf_dir}/full").collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_base(given[r["doc_id"]])


@pytest.mark.parametrize("name", ["op2_packing", "op6_sentencepiece", "op8_quality_classifier", "op10_quality_rules", "op13_best_fit_packing"])
def test_large_ids_beside_null_ones(spark, tmp_path, name):
    ids = [None, 2**53 + 1, 2**53 + 3, None, 5]
    docs = spark.createDataFrame([(i, "some words of text here", "en", "s", 1) for i in ids], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(str(r["doc_id"]) for r in registry.queries()[name](spark, str(tmp_path)).collect()) == sorted(map(str, ids))
