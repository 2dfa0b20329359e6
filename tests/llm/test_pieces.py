import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lawfinder.llm.pieces import MARK, PieceTrie, coded

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Hello  world\n é 漢𝄞 a\tb ", " leading", "trailing  ", " ", "   ", "aaaaaaaaaaaaaaa", "x" * 3000, "é ﬁ ＡＢ   ​ \x00 \x1c end", "internationalization of tokenization",
    "ciónmente queadoó straße Übergrößen", f"a{MARK}b {MARK}{MARK} c", "1234567 3.14159 --- ===", "if (x == 0) {\n    return    y;\n}", "The quick brown fox. " * 2000,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_text_equal_the_library(library):
    rng = random.Random(1)
    letters = "etaoinshrdlucmfwypvbgkjqxzéñü.,'-0123 "
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 200))) for _ in range(400)]
    codec = PieceTrie.from_file(PATH)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text), repr(text[:60])
        assert codec.decode(ids) == library.decode(library.encode(text))


def test_unigram_walk_is_viterbi():
    rng = random.Random(2)
    scores = {c: -5.0 for c in "abc"} | {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))): -rng.random() * 9 for _ in range(40)}
    codec = PieceTrie(scores, {p: i for i, p in enumerate(scores)}, list(range(1000, 1256)), unigram=True)
    names = list(scores)

    def best(word):
        top = [0.0] + [-np.inf] * len(word)
        for e in range(1, len(word) + 1):
            top[e] = max(top[s] + scores[word[s:e]] for s in range(e) if word[s:e] in scores)
        return top[-1]

    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(200)}
    for word, ids in codec.walk(words):
        pieces = [names[i] for i in np.frombuffer(ids, "<u4")]
        assert "".join(pieces) == word and abs(sum(scores[p] for p in pieces) - best(word)) < 1e-9


def test_frame(spark, library):
    rows = [(i, t, "x", 5) for i, t in enumerate([*TEXTS, None, ""] * 2)]
    found = coded(spark.createDataFrame(rows, "doc_id long, text string, ids string, n_ids long"), PATH).collect()
    assert len(found) == len(rows)
    for r in found:
        text = rows[r["doc_id"]][1]
        if text is None:
            assert r["ids"] is None and r["n_ids"] is None and r["decoded"] is None
            continue
        want = np.asarray(library.encode(text), "<u4").tobytes()
        assert bytes(r["ids"]) == want and r["ids_crc32"] == zlib.crc32(want) and r["n_ids"] == len(want) // 4
        assert r["decoded"] == library.decode(library.encode(text))
    assert coded(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
