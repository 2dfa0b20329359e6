"""Cost-balanced packing of token sequences.

Training on a packed sequence costs a linear part per token and, for
attention inside each document, a quadratic part. Pieces of documents are
dealt in descending length to the sequence of lowest cost so far that still
has room, so sequences end with like cost and little padding.

Defined cases: a null text counts as empty; every document ends with the end
id, so an empty one has one token; texts of any length are cut into whole
sequences plus one rest; repeated rows are packed once each; an empty table
gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import array
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import split_id, table, whole_id

CAPACITY = 4096
END_ID = 2
#: Pieces that are packed together, at most as a mean; bounds a task's memory and the padding of a group's last sequence.
GROUP = 4096
#: Distinct chunks, and distinct parts of chunks, whose ids a Python worker keeps.
CACHE = 500_000
#: Attention's share of the cost of a token, per token before it in its document.
QUADRATIC = 1.0 / 2048

_PIECES = "no_id boolean, own_id long, start long, length long, doc_tokens long, ids binary"
_PLACED = "no_id boolean, own_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary, sequence_id long, offset long"
_COLUMNS = ["no_id", "own_id", "start", "length", "doc_tokens", "ids"]

# Plain characters: printable ASCII with its white space, Latin letters, and the marks of Western languages. On these
# neither the tokenizer's normalisation nor its letter classes need more than lower() and the pattern of parts.
_ODD = re.compile("[^\t-\r\x20-\x7e\xa1\xab\xbb\xbf-\u024f]|<\\|")
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
# The settings of a tokenizer under which its chunks are those of the two patterns above.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}


def _byte_names() -> dict[int, str]:
    """The printable character that a byte-level vocabulary uses for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkIds(dict):
    """Ids of a text, joined from those of its chunks between white space.

    The tokenizer lower-cases, splits at white space, then into runs of
    letters, single digits and runs of other characters, and each such part
    goes to its vocabulary alone; so chunks and parts are remembered with
    their ids. A text with any character that might act on its neighbours
    (other scripts, combining marks, rare white space, special tokens) is
    given to the tokenizer whole, and so is every text where the tokenizer's
    settings are others.
    """

    def __init__(self, path: str, dtype: str, most: int = CACHE):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype, self.most = dtype, most
        self.parts: dict[str, bytes] = {}
        self.names = _byte_names()
        self.chunked = self._known()

    def _known(self) -> bool:
        """Whether the tokenizer normalises and splits as the chunks here do."""
        steps = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        settings = [None if step is None else json.loads(step.__getstate__()) for step in steps]
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        return settings == [_NORMALIZER, _PRE_TOKENIZER] and all(t.startswith("<|") for t in added)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            named = part if part.isascii() else "".join(map(self.names.__getitem__, part.encode()))
            ids = array.array("H" if self.dtype == "<u2" else "I", [t.id for t in self.tokenizer.model.tokenize(named)]).tobytes()
            if len(self.parts) < self.most and len(part) <= 64:
                self.parts[part] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        ids = b"".join(map(self.part, _PART.findall(chunk)))
        if len(self) < self.most and len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def of(self, text: str) -> bytes:
        if not self.chunked or _ODD.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.lower().split()))


@lru_cache(maxsize=4)
def chunk_ids(kind: type[ChunkIds], path: str, dtype: str) -> ChunkIds:
    """The chunks that this Python worker knows; later tasks of the worker go on with them."""
    return kind(path, dtype)


def _width(tokenizer_path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize documents and cut them into whole sequences and one shorter rest each.

    A document is told by no_id and own_id. ``ids`` holds little-endian unsigned ids of 16 bits where the vocabulary
    allows it, else of 32.
    """
    dtype = _width(tokenizer_path)
    size = int(dtype[-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = ChunkIds(tokenizer_path, dtype)
        end = np.asarray([end_id], dtype=dtype).tobytes()
        width = size * capacity
        for batch in batches:
            rows: list[tuple[bool, int, int, int, int, bytes]] = []
            held = 0
            for no_id, own_id, text in zip(batch["no_id"], batch["own_id"], batch["text"], strict=True):
                ids = ids_of.of(text or "") + end
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    rows.append((no_id, own_id, at // size, len(part) // size, len(ids) // size, part))
                    held += len(part)
                if held > 4 << 20:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=_COLUMNS)

    return docs.select(*split_id(), "text").mapInPandas(run, schema=_PIECES)


def place(lengths: np.ndarray, capacity: int, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Deal pieces, longest first, to the cheapest sequence with room.

    Returns for each sequence its (piece, first token, tokens). The number of
    sequences is the least that can hold all tokens. A piece that no sequence
    can take whole is cut and goes on to the next cheapest ones with room.
    """
    count = max(1, -(-int(lengths.sum()) // capacity))
    room = np.full(count, capacity, dtype=np.int64)
    cost = np.zeros(count)
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    for piece in np.argsort(-lengths, kind="stable"):
        length, first = int(lengths[piece]), 0
        while length:
            fits = np.where(room >= length, cost, np.inf)
            best = int(fits.argmin())
            if not np.isfinite(fits[best]):
                best = int(room.argmax())
            took = min(length, int(room[best]))
            held[best].append((int(piece), first, took))
            room[best] -= took
            cost[best] += took + quadratic * took * took
            first, length = first + took, length - took
    return held


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
    group: int = GROUP, quadratic: float = QUADRATIC, with_ids: bool = True,
) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, start, length, doc_tokens, ids_crc32
    and ids (of 32-bit little-endian ids; null unless ``with_ids``),
    sequence_id and offset. Pieces are dealt by hash to groups and packed
    inside each. A document has at most one rest, and no more whole pieces
    than its bytes fill, which bounds the mean size of a group by ``group``.
    """
    size = docs.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")
    ).first()
    groups = max(1, -(-(size["n"] + size["bytes"] // capacity) // group))
    dtype = _width(tokenizer_path)
    step = int(dtype[-1])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "no_id", "own_id", "start"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        none, doc, start, tokens, ids = (rows[c].to_list() for c in ("no_id", "own_id", "start", "doc_tokens", "ids"))
        made = []
        for number, content in enumerate(place(rows["length"].to_numpy(), capacity, quadratic)):
            offset = 0
            for piece, first, took in content:
                own = np.frombuffer(ids[piece], dtype)[first : first + took].astype("<u4").tobytes()
                made.append((none[piece], doc[piece], start[piece] + first, took, tokens[piece], zlib.crc32(own), own if with_ids else None, (int(key[0]) << 32) + number, offset))
                offset += took
        return pd.DataFrame(made, columns=["no_id", "own_id", "start", "length", "doc_tokens", "ids_crc32", "ids", "sequence_id", "offset"])

    pieces = token_pieces(docs, tokenizer_path, capacity, end_id)
    # A row's own number is in the hash, so that rows of one id, or of none, and copies of a text spread over all groups.
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("own_id", "start", F.monotonically_increasing_id()), F.lit(groups)))
    placed = dealt.groupBy("part").applyInPandas(run, schema=_PLACED)
    return placed.select(whole_id(), "start", "length", "doc_tokens", "ids_crc32", "ids", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
