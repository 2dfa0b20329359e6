"""SentencePiece encoding and decoding by a shared-prefix forward pass.

Texts are split into marked words: a run of word marks with the characters
after it. No piece of a vocabulary goes on from other characters into a mark,
so marked words are encoded alone. The distinct words of a batch are sorted
and visited like a depth-first walk of their trie: what the forward pass knew
at a shared prefix is kept from the word before.

For a unigram vocabulary the forward pass is Viterbi's: the best sum of piece
scores up to each place. The given vocabulary is a BPE one, whose result is
not the best sum of scores, so there the pass keeps for each prefix the last
piece of its encoding. That piece is the only one that ends there and stands
unmerged beside the last piece of the prefix before it, so the recurrence and
the walk are the same and the result is exactly that of merging by score.

Defined cases: a null text gives null ids, an empty one none; characters
outside the vocabulary become byte pieces; words of any length are encoded
whole; repeated rows are encoded each; further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import split_id, table, whole_id

MARK = "▁"
#: Distinct words, and pairs of pieces, that a Python worker remembers.
CACHE = 400_000
#: Characters of text whose distinct words are walked together.
TOGETHER = 4 << 20

_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_CODED = "no_id boolean, own_id long, n_ids long, ids binary, ids_crc32 long, decoded string"


class PieceTrie:
    """Encoder and decoder of one vocabulary, given as pieces with scores; bytes has the ids of byte pieces."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], byte_ids: list[int], unigram: bool = False):
        self.scores, self.ids, self.byte_ids, self.unigram = scores, ids, byte_ids, unigram
        tails: dict[str, set[int]] = {}
        for piece in scores:
            if len(piece) > 1:
                tails.setdefault(piece[-2:], set()).add(len(piece))
        #: Lengths of the pieces that end with two characters, longest first.
        self.lengths = {tail: sorted(found, reverse=True) for tail, found in tails.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.texts = {i: p.encode() for p, i in ids.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}

    @staticmethod
    @lru_cache(maxsize=2)
    def shared(path: str) -> PieceTrie:
        """The codec of a file that all tasks of a Python worker use, with what it remembers."""
        return PieceTrie.from_file(path)

    @classmethod
    def from_file(cls, path: str, unigram: bool = False) -> PieceTrie:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        ids = {model.id_to_piece(i): i for i in usual}
        split = [p for p in ids if MARK in p.lstrip(MARK)]
        if split:
            raise ValueError(f"pieces reach across word marks: {split[:3]}")
        return cls({p: model.get_score(i) for p, i in ids.items()}, ids, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], unigram)

    def merged(self, text: str) -> list[str]:
        """Merge neighbours of highest score, leftmost first, until none is a piece."""
        parts = list(text)
        while True:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1], -np.inf)
                if score > best:
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def apart(self, left: str, right: str) -> bool:
        """Whether two pieces beside each other stay unmerged."""
        found = self.pairs.get((left, right))
        if found is None:
            found = self.merged(left + right) == [left, right]
            if len(self.pairs) < CACHE:
                self.pairs[left, right] = found
        return found

    def _step(self, word: str, end: int, last: list[str], best: list[float]) -> None:
        """Extend the forward pass by the character before ``end``."""
        chosen, top = word[end - 1], -np.inf
        if self.unigram:
            top = best[end - 1] + self.scores.get(chosen, -1e4)
        for length in self.lengths.get(word[max(0, end - 2) : end], ()):
            if length > end:
                continue
            piece = word[end - length : end]
            score = self.scores.get(piece)
            if score is None:
                continue
            if self.unigram:
                total = best[end - length] + score
                if total > top:
                    chosen, top = piece, total
            elif length == end or self.apart(last[end - length], piece):
                chosen = piece
                break
        last.append(chosen)
        best.append(top)

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Encode distinct words in sorted order, each from the prefix it shares with the one before."""
        before, last, best = "", [""], [0.0]
        for word in sorted(words):
            same = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                same += 1
            del last[same + 1 :], best[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                self._step(word, end, last, best)
            before, at, found = word, len(word), []
            while at:
                piece = last[at]
                i = self.ids.get(piece)
                found.extend([i] if i is not None else [self.byte_ids[b] for b in reversed(piece.encode("utf-8", "surrogatepass"))])
                at -= len(piece)
            found.reverse()
            yield word, np.asarray(found, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        units = [_UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.words
        fresh = dict(self.walk({u for unit in units for u in unit} - known.keys()))
        out = [b"".join([known[u] if u in known else fresh[u] for u in unit]) for unit in units]
        for word, ids in fresh.items():
            if len(known) >= CACHE:
                break
            if len(word) <= 32:
                known[word] = ids
        return out

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def coded(docs: DataFrame, model_path: str, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """Encode documents and decode the ids again.

    Returns doc_id, n_ids, ids (32-bit little-endian; null unless
    ``with_ids``), ids_crc32 and decoded (null unless ``with_text``).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = PieceTrie.shared(model_path)
        for batch in batches:
            size = batch["text"].str.len().fillna(0).cumsum() // TOGETHER
            for _, part in batch.groupby(size, sort=False):
                texts = part["text"].to_list()
                ids = [e if t is not None else None for t, e in zip(texts, codec.encode([t or "" for t in texts]), strict=True)]
                yield pd.DataFrame({
                    "no_id": part["no_id"], "own_id": part["own_id"],
                    "n_ids": pd.array([len(e) // 4 if e is not None else None for e in ids], dtype="Int64"),
                    "ids": ids if with_ids else None,
                    "ids_crc32": pd.array([zlib.crc32(e) if e is not None else None for e in ids], dtype="Int64"),
                    "decoded": [codec.decode(e) if e is not None and with_text else None for e in ids],
                })

    found = docs.select(*split_id(), "text").mapInPandas(run, schema=_CODED)
    return found.select(whole_id(), *[c for c in found.columns if c not in ("no_id", "own_id")])


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = coded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
    return found.select("doc_id", "n_ids", "ids_crc32", F.crc32(F.encode("decoded", "UTF-8")).alias("decoded_crc32"))
