import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lawfinder.llm.packing import ChunkIds, pack, place

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello world, don't stop 123!", None, "", " \n\t", "É à ñ ¿qué? straße İx ΣΑΣ 漢字 á", "x\x00y\x1cz\x85w <|endoftext|> end", "word " * 9000, "a_b__c's'S", "x" * 5000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_chunks_equal_the_tokenizer(tokenizer):
    fast = ChunkIds(PATH, "<u4")
    every = [chr(c) for c in range(0x250)]
    for text in [*(t or "" for t in TEXTS), *every, *("a" + c + "b1" for c in every), *("." + c + c + "!" for c in every)]:
        assert fast.of(text) == np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_other_tokenizers_see_whole_texts(tokenizer):
    assert ChunkIds(PATH, "<u4").chunked
    other = public_tokenizers.path("byte_bpe_50k.json")
    fast, exact = ChunkIds(other, "<u4"), Tokenizer.from_file(other)
    assert not fast.chunked
    for text in (t or "" for t in TEXTS):
        assert fast.of(text) == np.asarray(exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text[:40])


def test_every_id_lies_in_one_piece(spark, tokenizer):
    rows = [(i, t, "x", 7) for i, t in enumerate(TEXTS * 20)]
    packed = pack(spark.createDataFrame(rows, "doc_id long, text string, ids string, part long"), PATH, group=32)
    found = packed.collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text, *_ in rows:
        ids = np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in pieces) == ids
        assert [r["start"] for r in pieces] == list(np.cumsum([0, *(r["length"] for r in pieces)])[:-1])
        assert all(r["doc_tokens"] == len(ids) // 4 for r in pieces)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == list(np.cumsum([0, *(r["length"] for r in pieces)])[:-1])
        assert sum(r["length"] for r in pieces) <= 4096


def test_place_fills_and_balances():
    lengths = np.random.default_rng(1).integers(1, 3000, 500)
    held = place(lengths, 4096, 1 / 2048)
    used = [sum(n for *_, n in h) for h in held]
    assert sum(used) == lengths.sum() and len(held) == -(-lengths.sum() // 4096)
    cost = [sum(n + n * n / 2048 for *_, n in h) for h in held]
    assert np.std(cost) < 0.35 * np.mean(cost)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_large_ids_beside_null_ones_and_one_id_on_all_rows(spark):
    """A null beside them leaves ids above 2^53 as they are, and rows of one id do not all meet in one group."""
    ids = [None, 2**53 + 1, 2**53 + 3, None]
    rows = pack(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string"), PATH).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(map(str, ids))
    same = pack(spark.createDataFrame([(None, "a b")] * 600, "doc_id long, text string"), PATH, group=20).collect()
    groups = {}
    for r in same:
        groups[r["sequence_id"] >> 32] = groups.get(r["sequence_id"] >> 32, 0) + 1
    assert len(same) == 600 and max(groups.values()) < 60
