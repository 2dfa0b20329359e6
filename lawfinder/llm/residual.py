"""Best-fit packing in a hierarchy of groups.

Documents longer than a sequence are cut into whole sequences and one shorter
first piece; whole ones need no partner. All other pieces are dealt to groups
of bounded size, and each group is packed best-fit, longest piece first: a
piece goes into the bin with least room that still holds it. Nearly full bins
are done. The emptiest of the others go on as items of their own, groups join
in a tree, and each joined group is packed best-fit again, until one group is
left. A group passes on at most its share of the next group's size, so no
task's work grows with the input, whatever the lengths; the rest of its bins
are done too.

A bin carries its pieces, at most as many as it has tokens, so joined bins
are joined lists and nothing needs to be looked up afterwards.

Defined cases: a null text counts as empty; every document ends with the end
id, so an empty one has one token; texts of any length are cut; repeated rows,
and rows that share a doc_id or lack one, are packed once each; an empty table
gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import array
import json
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .packing import CACHE, ChunkIds

CAPACITY = 2048
END_ID = 0
#: Pieces of a group, as a mean, and most bins of a joined group.
GROUP = 4096
#: Groups that join into one.
FAN = 8
#: Room, as a share of a sequence, under which a bin is done.
NEARLY = 1 / 64

# White space before a chunk belongs to it if it is one blank; this is how the byte-level pattern splits, so that no token
# reaches over the ends of a chunk.
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# Inside a chunk the pattern splits on, into parts that go to the vocabulary alone.
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\w\s]|_)+|\s+")
# On other characters than printable ASCII with its white space and Latin letters Python's classes may differ from the
# tokenizer's; its special tokens begin with <|.
_ODD = re.compile("[^\t-\r\x20-\x7e\xa1\xab\xbb\xbf-\u024f]|<\\|")
# The same of ASCII, where a search for few characters is the quicker one.
_ODD_ASCII = re.compile("[\0-\x08\x0e-\x1f\x7f]|<\\|")
# White space that may run on: with none of it each chunk ends at one blank or line end.
_RUNS = ("  ", "\n\n", "\n ", " \n", "\t", "\r", "\x0b", "\x0c")
# The settings of a tokenizer that splits so.
_PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

_PIECE = "doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint, ids: binary"


class Chunks(ChunkIds):
    """Ids of texts by a byte-level tokenizer, joined from those of chunks that it never joins, which are remembered.

    A key stands for a chunk: for the blank and the key, or for the line end that it begins with and what follows,
    or, after a null character, for what begins a text. So a text whose white space never runs on is cut at its blanks alone.
    """

    def __init__(self, path: str, dtype: str, most: int = CACHE):
        super().__init__(path, dtype, most)
        self.model = self.tokenizer.model
        self.code = "H" if dtype == "<u2" else "I"

    def _known(self) -> bool:
        settings = self.tokenizer.pre_tokenizer
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        split = None if settings is None else json.loads(settings.__getstate__())
        return self.tokenizer.normalizer is None and split == _PRE_TOKENIZER and all(t.startswith("<|") for t in added)

    def made(self, part: str) -> bytes:
        named = "".join(map(self.names.__getitem__, part.encode()))
        return array.array(self.code, [t.id for t in self.model.tokenize(named)]).tobytes()

    def part(self, part: str) -> bytes:
        if part[0] == " " and len(part) > 1 and not part[1].isspace():
            return self[part[1:]]
        ids = self.parts.get(part)
        if ids is None:
            ids = self.made(part)
            if len(self.parts) < self.most and len(part) <= 64:
                self.parts[part] = ids
        return ids

    def __missing__(self, key: str) -> bytes:
        chunk = key if key[0] == "\n" else key[1:] if key[0] == "\0" else " " + key
        parts = [chunk] if key.isalpha() else _PART.findall(chunk)
        ids = self.made(chunk) if parts == [" " + key] else b"".join(map(self.part, parts))
        # Keys over a line end hardly come again.
        if len(self) < self.most and len(key) <= 64 and key[0] != "\n":
            self[key] = ids
        return ids

    def of(self, text: str) -> bytes:
        if not self.chunked or (_ODD_ASCII if text.isascii() else _ODD).search(text):
            return self.whole(text)
        if not text or text[0].isspace() or text[-1].isspace() or any(run in text for run in _RUNS):
            return b"".join([self[c[1:]] if c[0] == " " and len(c) > 1 and not c[1].isspace() else self.spaced(c) for c in _CHUNK.findall(text)])
        return b"".join(map(self.__getitem__, ("\0" + text.replace("\n", " \n")).split(" ")))

    def spaced(self, chunk: str) -> bytes:
        """Ids of a chunk that no blank leads."""
        return b"".join(map(self.part, _PART.findall(chunk)))


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces of all documents, each with a number of its own once they are written."""
    from tokenizers import Tokenizer

    dtype = "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    size = int(dtype[-1])
    fields = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Each task begins anew, so that its time does not hang on what its worker did before.
        known = Chunks(tokenizer_path, dtype)
        end = np.asarray([end_id], dtype=dtype).tobytes()
        for batch in batches:
            made: tuple[list, ...] = tuple([] for _ in fields)
            held = 0

            def out(batch=batch, made=None):
                row, *rest = made
                # The ids of documents never leave Arrow, so a null beside a long changes neither.
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(v, t) for v, t in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], fields)

            for row, text in enumerate(batch.column(1)):
                ids = known.of(text.as_py() or "") + end
                count = len(ids) // size
                start, piece = 0, 0
                while start < count:
                    length = ((count - 1) % capacity + 1) if start == 0 else capacity
                    own = np.frombuffer(ids, dtype, length, start * size).astype("<u4").tobytes()
                    for values, v in zip(made, (row, piece, start, length, zlib.crc32(own), own if with_ids else None), strict=True):
                        values.append(v)
                    start, piece, held = start + length, piece + 1, held + (len(own) if with_ids else 0)
                if held > 4 << 20:
                    yield out(made=made)
                    made, held = tuple([] for _ in fields), 0
            if made[0]:
                yield out(made=made)

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECE.replace(":", ""))
    return cut(made.withColumn("number", F.monotonically_increasing_id()))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items, given longest first, each in the bin of least room that holds it; the items of each bin.

    Bins are found by their room: a number's bits say which rooms some bin has.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for item, size in enumerate(sizes):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(item)
        by_room[room - size].append(at)
        rooms |= 1 << (room - size)
    return bins


def packed_groups(items: DataFrame, capacity: int, level: int, pass_on: int) -> DataFrame:
    """Bins of each group ``part`` of items (number, fill, content): with ``sequence_id``, and ``open`` for the at most ``pass_on`` emptiest that are not nearly full."""
    content = items.schema["content"].dataType.simpleString()

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("fill", "descending"), ("number", "ascending")])
        fill = rows.column("fill").to_numpy()
        bins = best_fit(fill.tolist(), capacity)
        order = np.array([i for b in bins for i in b], dtype=np.int64)
        first = np.cumsum([0, *(len(b) for b in bins)])
        filled = np.add.reduceat(fill[order], first[:-1])
        # A list per item becomes a list per bin: its items' lists, end to end.
        lists = rows.column("content").combine_chunks().take(pa.array(order))
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])[first]
        joined = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), lists.flatten())
        room = capacity - filled
        emptiest = np.lexsort((np.arange(len(bins)), -room))
        rank = np.empty(len(bins), dtype=np.int64)
        rank[emptiest] = np.arange(len(bins))
        opened = (rank < pass_on) & (room > capacity * NEARLY)
        part = key[0].as_py()
        return pa.table({
            "part": pa.array(np.full(len(bins), part)), "number": pa.array(rows.column("number").to_numpy()[order[first[:-1]]]), "fill": pa.array(filled.astype(np.int64)),
            "content": joined, "open": pa.array(opened), "sequence_id": pa.array((1 << 62) + (level << 56) + (part << 24) + np.arange(len(bins), dtype=np.int64)),
        })

    return items.groupBy("part").applyInArrow(run, f"part long, number long, fill long, content {content}, open boolean, sequence_id long")


def pack_best_fit(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP, fan: int = FAN, with_ids: bool = True) -> DataFrame:
    """Pack documents into few sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32 and ids
    (of 32-bit little-endian ids; null unless ``with_ids``), sequence_id and
    offset.
    """
    pieces = pieces_of(docs, tokenizer_path, capacity, end_id, with_ids)
    fields = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    items = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-items.count() // group))
    # Dealt by the piece's own number, which is written down: copies and repeated ids spread like other rows.
    dealt = items.select(
        F.pmod(F.xxhash64("number"), F.lit(groups)).alias("part"), "number", F.col("length").alias("fill"), F.array(F.struct(*fields)).alias("content")
    )
    done, level = [], 0
    while True:
        last = groups == 1
        bins = cut(packed_groups(dealt, capacity, level, 0 if last else max(1, group // fan)))
        done.append(bins.where("not open"))
        if last:
            break
        groups = -(-groups // fan)
        dealt = bins.where("open").select(F.floor(F.col("part") / fan).cast("long").alias("part"), "number", "fill", "content")
        level += 1
    bins = reduce(DataFrame.unionByName, done)
    each = bins.select("sequence_id", F.posexplode("content").alias("place", "p"), "content")
    before = F.aggregate(F.slice("content", 1, F.col("place")), F.lit(0).cast("long"), lambda a, p: a + p["length"])
    out = [*fields, *([] if with_ids else ["ids"])]
    shared = each.select("p.*", "sequence_id", before.alias("offset"))
    alone = pieces.where(F.col("length") == capacity).select(*fields, F.col("number").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    both = shared.unionByName(alone)
    return (both if with_ids else both.withColumn("ids", F.lit(None).cast("binary"))).select(*out, "sequence_id", "offset")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
