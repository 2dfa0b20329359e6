"""Quality rules: base rules and bands of n-gram perplexity.

Modified Kneser-Ney models of characters, one per language and half of the
documents, judge the documents of the other half, so none (and no exact copy)
judges itself. Spark counts the n-grams, continuations, contexts and count
classes and joins them to probabilities; they are written to the shared folder
as sorted arrays of 64-bit hashes, cut into segments of bounded size by their
first bits. Tasks read the segments of the languages they meet and keep as
many as fit in ``CACHE`` bytes, so models may have any size and number; they
grow with the corpus and never pass the driver. Characters are those of the
text in lower case, with digits as 0, other white space than line ends as
spaces, symbols as # and brackets and signs as /; scripts are left as they are.

A document whose perplexity lies outside its language's band is rejected, as
is one that fails a base rule. A band is cut from the documents labelled
clean, so that it rejects ``FALSE_REJECTION`` of them; all labelled rows are
used alike. A language with too few of them gets a fence around the quartiles
of its documents that pass the base rules.

Defined cases: a null text counts as empty; a text without words has no
perplexity and fails the base rules; a null language is a language of its
own; a document whose language has none in the other half has no perplexity
and is judged by the base rules; repeated rows are counted and judged each;
labels of one id that differ do not call it clean; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, scratch_folder, split_id, table, whole_id
from .textstats import mixed, word_bounds, word_hashes

ORDER = 5
#: The share of clean documents that a band may reject, half of it on either side.
FALSE_REJECTION = 0.01
#: Documents labelled clean from which a language's band is cut, at least.
FEWEST_CLEAN = 100
#: With fewer, a band reaches this many interquartile ranges of log perplexity beyond the quartiles.
BAND = 3.0
#: Log perplexities are told apart to this step where bands are cut.
STEP = 1e-4
FEWEST_WORDS = 50
#: Entries of a model's segment, about; bytes of segments that a Python worker keeps; characters scored or counted together.
SEGMENT, CACHE, TOGETHER = 1_000_000, 256 << 20, 4 << 20

_ROLL = np.uint64(0x9E3779B97F4A7C15)
_GRAM, _CONTEXT, _SIZE = 0, 16, 32
_PLAIN = np.arange(128, dtype=np.uint32)
_PLAIN[ord("0") : ord("9") + 1] = ord("0")
_PLAIN[[9, 11, 12, 13]] = 32
_PLAIN[[ord(c) for c in "#*$%&<>"]] = ord("#")
_PLAIN[[ord(c) for c in "()+/=@[\\]^_`{}~"]] = ord("/")


def padded(text: str, order: int, most: int) -> list[str]:
    """A text in lower case between two spaces; a very long one in pieces that hold each run of ``order`` symbols once."""
    full = f" {text.lower()} ".replace("\0", " ")
    if len(full) <= most:
        return [full]
    return [full[i : i + most + order - 1] for i in range(0, len(full) - order + 1, most)]


def symbols(pieces: list[str]) -> np.ndarray:
    """Code points of pieces of text, with a 0 after each."""
    codes = np.frombuffer("\0".join([*pieces, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(codes < 128, _PLAIN[np.minimum(codes, 127)], codes)


def windows(codes: np.ndarray, order: int) -> np.ndarray:
    """Starts of the runs of ``order`` symbols that lie inside one text."""
    n = max(0, len(codes) - order + 1)
    inside = np.ones(n, dtype=bool)
    for i in range(order):
        inside &= codes[i : i + n] != 0
    return np.flatnonzero(inside)


def keys(codes: np.ndarray, at: np.ndarray, length: int, tag: int) -> np.ndarray:
    """Hashes of the runs of ``length`` symbols at given places."""
    if length and len(at) > len(codes) // 2:  # of nearly all places: over the whole row of symbols first
        each, n = codes.astype(np.uint64), len(codes) - length + 1
        whole = each[:n].copy()
        for i in range(1, length):
            whole *= _ROLL
            whole += each[i : i + n]
        out = whole[at]
    else:
        out = np.zeros(len(at), dtype=np.uint64)
        for i in range(length):
            out = out * _ROLL + codes[at + i].astype(np.uint64)
    return mixed(out + np.uint64((tag + length) * 0xD1B54A32D192ED03 % (1 << 64))).view(np.int64)


def gram_counts(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The different runs of ``order`` symbols inside texts, and how often each occurs."""
    at = windows(codes, order)
    used = np.flatnonzero(np.bincount(codes, minlength=1))
    size = max(2, len(used))
    if size**order < 1 << 63:
        # Few enough symbols: a run is one whole number, and plain numbers sort much faster than places do.
        rank = np.zeros(int(used[-1]) + 1 if len(used) else 1, dtype=np.int64)
        rank[used] = np.arange(len(used))
        ranks, n = rank[codes], max(0, len(codes) - order + 1)
        packed = np.zeros(n, dtype=np.int64)
        for i in range(order):
            packed *= size
            packed += ranks[i : i + n]
        packed = np.sort(packed[at])
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(packed)), dtype=bool), packed[1:] != packed[:-1]]))
        times = np.diff(np.append(first, len(packed)))
        left, symbols_of = packed[first], []
        for _ in range(order):
            left, last = np.divmod(left, size)
            symbols_of.append(used[last] if len(used) else last)
        runs = np.column_stack(symbols_of[::-1])
    else:
        _, first, times = np.unique(keys(codes, at, order, 0), return_index=True, return_counts=True)
        runs = codes[at[first][:, None] + np.arange(order)]
    return np.ascontiguousarray(runs.astype("<u4")).view(f"<U{order}").ravel(), times


def counted(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(model, g, n): how often each n-gram occurs in the documents of a model; counted within tasks first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[str]] = {}

        def counts() -> Iterator[pd.DataFrame]:
            for model, texts in held.items():
                codes = symbols(texts)
                grams, n = gram_counts(codes, order)
                yield pd.DataFrame({"model": model, "g": grams.astype(object), "n": n})
            held.clear()

        size = 0
        for batch in batches:
            for model, text in zip(batch["model"], batch["text"], strict=True):
                for piece in padded(text or "", order, TOGETHER):
                    held.setdefault(model, []).append(piece)
                    size += len(piece)
                    if size >= TOGETHER:
                        yield from counts()
                        size = 0
        yield from counts()

    parts = docs.select("model", "text").mapInPandas(run, schema="model string, g string, n long")
    return parts.groupBy("model", "g").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """Interpolated modified Kneser-Ney from the counts of the longest n-grams.

    Returns (model, tag, g, value): the log probability of each n-gram's last
    symbol (tag 0), the log weight with which each context backs off (16), and
    the log probability of symbols that a model has not seen (32).
    """
    levels = {order: cut(counts)}
    for k in range(order - 1, 0, -1):
        above = levels[k + 1]
        levels[k] = cut(above.groupBy("model", F.substring("g", 2, k).alias("g")).agg(F.count(F.lit(1)).alias("n")))
    fresh = levels[1].groupBy("model").agg((F.count(F.lit(1)) + 1).alias("symbols"))
    out = fresh.select("model", F.lit(_SIZE).alias("tag"), F.lit("").alias("g"), (-F.log("symbols")).alias("value"))
    lower = fresh.select("model", F.lit("").alias("rest"), (1 / F.col("symbols")).alias("below"))
    for k in range(1, order + 1):
        # Chen and Goodman's discounts for counts 1, 2 and 3 or more
        m = [F.greatest(F.sum(F.when(F.col("n") == i, 1).otherwise(0)), F.lit(1)).cast("double") for i in (1, 2, 3, 4)]
        y = m[0] / (m[0] + 2 * m[1])
        off = [F.least(F.lit(float(i)), F.greatest(F.lit(0.05), i - (i + 1) * y * m[i] / m[i - 1])) for i in (1, 2, 3)]
        discounts = levels[k].groupBy("model").agg(F.array(*off).alias("off"))
        own = levels[k].join(discounts, "model").select("model", "g", "n", F.element_at("off", F.least(F.col("n"), F.lit(3)).cast("int")).alias("off"), F.substring("g", 1, k - 1).alias("context"), F.substring("g", 2, k - 1).alias("rest"))
        contexts = cut(own.groupBy("model", "context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("weight")))
        below = lower.select("model", "rest", "below")
        level = own.join(contexts, ["model", "context"]).join(below, ["model", "rest"])
        level = cut(level.select("model", "g", ((F.col("n") - F.col("off")) / F.col("total") + F.col("weight") * F.col("below")).alias("p")))
        out = out.unionByName(level.select("model", F.lit(_GRAM).alias("tag"), "g", F.log("p").alias("value")))
        out = out.unionByName(contexts.select("model", F.lit(_CONTEXT).alias("tag"), F.col("context").alias("g"), F.log("weight").alias("value")))
        lower = level.select("model", F.col("g").alias("rest"), F.col("p").alias("below"))
    return out


def _file_name(model: Column) -> Column:
    return F.hex(F.encode(model, "UTF-8"))


def stored(entries: DataFrame) -> tuple[str, int]:
    """Write a model's entries as sorted arrays of hashes; returns the folder and how many first bits tell segments apart."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (tag, length), part in batch.groupby(["tag", "length"]):
                codes = np.frombuffer("".join(part["g"]).encode("utf-32-le"), dtype="<u4")
                at = np.arange(len(part)) * length
                yield pd.DataFrame({"model": part["model"].to_numpy(), "key": keys(codes, at, int(length), int(tag)), "value": part["value"].to_numpy()})

    rows = cut(entries.withColumn("length", F.length("g")).mapInPandas(hashed, schema="model string, key long, value float"))
    most = rows.groupBy("model").count().agg(F.max("count")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, most) / SEGMENT)))
    by = ["file", "segment"]
    segment = F.shiftright("key", 64 - bits).cast("int") if bits else F.lit(0)
    placed = rows.select(_file_name(F.col("model")).alias("file"), segment.alias("segment"), "key", "value").repartition(*by).sortWithinPartitions(*by, "key")
    path = scratch_folder(entries.sparkSession)
    placed.write.partitionBy(*by).parquet(path)
    return path, bits


class Segment:
    """Sorted hashes with values. Hashes are even, so the next bits of one tell where it stands, to a few places."""

    def __init__(self, key: np.ndarray, value: np.ndarray, bits: int):
        self.bits, self.own = np.uint64(bits), max(1, (len(key) - 1).bit_length())
        self.value = np.append(value, np.float32(0))
        self.known = np.append(key, np.int64(0))
        self.first = np.searchsorted(self.place(key), np.arange((1 << self.own) + 1)).astype(np.int32)
        self.size = self.known.nbytes + self.value.nbytes + self.first.nbytes

    def place(self, key: np.ndarray) -> np.ndarray:
        plain = key.view(np.uint64) ^ np.uint64(1 << 63)
        return ((plain << self.bits) >> np.uint64(64 - self.own)).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key, 0 where it has none, and whether it has."""
        place = self.place(key)
        at, end = self.first[place], self.first[place + 1]
        hit = (self.known[at] == key) & (at < end)
        value = np.where(hit, self.value[at], 0.0)
        todo = np.flatnonzero(~hit & (at + 1 < end))
        while len(todo):
            at[todo] += 1
            now = at[todo]
            same = self.known[now] == key[todo]
            value[todo[same]], hit[todo[same]] = self.value[now[same]], True
            todo = todo[~same & (now + 1 < end[todo])]
        return value, hit


class Models:
    """Segments of stored models, read when they are first needed; the ones used last stay in memory."""

    def __init__(self, path: str, bits: int):
        from pyarrow import fs

        local = not path.split(":", 1)[0].isalnum() or path.startswith("file:")
        self.files, self.root = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(path)
        self.bits, self.held, self.size = bits, OrderedDict(), 0

    @staticmethod
    @lru_cache(maxsize=1)
    def shared(path: str, bits: int) -> Models:
        return Models(path, bits)

    def segment(self, model: str, number: int) -> Segment:
        at = (model, number)
        if at in self.held:
            self.held.move_to_end(at)
            return self.held[at]
        import pyarrow.parquet as pq
        from pyarrow import fs

        folder = f"{self.root}/file={model.encode().hex().upper()}/segment={number}"
        found = [f.path for f in self.files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.path.endswith(".parquet")]
        parts = [pq.ParquetFile(self.files.open_input_file(f)).read(["key", "value"]) for f in found]
        key = np.concatenate([p["key"].to_numpy() for p in parts]) if parts else np.zeros(0, np.int64)
        value = np.concatenate([p["value"].to_numpy() for p in parts]) if parts else np.zeros(0, np.float32)
        if len(parts) > 1:
            by = np.argsort(key)
            key, value = key[by], value[by]
        self.held[at] = found = Segment(key, value, self.bits)
        self.size += found.size
        while self.size > CACHE and len(self.held) > 1:
            self.size -= self.held.popitem(last=False)[1].size
        return found

    def find(self, model: str, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key, 0 where it has none, and whether it has."""
        numbers = key >> (64 - self.bits) if self.bits else np.zeros(len(key), np.int64)
        value, hit = np.zeros(len(key)), np.zeros(len(key), dtype=bool)
        for number in np.unique(numbers).tolist():
            own = np.flatnonzero(numbers == number) if self.bits else slice(None)
            value[own], hit[own] = self.segment(model, number).find(key[own])
        return value, hit

    def log_probabilities(self, model: str, codes: np.ndarray, at: np.ndarray, order: int) -> np.ndarray | None:
        """Natural log probability of the last symbol of each run of ``order`` symbols; none where there is no such model."""
        fresh, known = self.find(model, keys(codes, np.zeros(1, np.int64), 0, _SIZE))
        if not known[0]:
            return None
        out = np.zeros(len(at))
        todo = np.arange(len(at))
        for k in range(order, 0, -1):
            start = at[todo] + order - k
            value, hit = self.find(model, keys(codes, start, k, _GRAM))
            out[todo] += value
            todo, start = todo[~hit], start[~hit]
            if not len(todo):
                return out
            out[todo] += self.find(model, keys(codes, start, k - 1, _CONTEXT))[0]
        out[todo] += fresh[0]
        return out


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    starts, ends = word_bounds(raw)
    n = len(starts)
    spaces = sum(text.count(c) for c in " \t\n\r\x0b\x0c")
    marks = sum(text.count(c) for c in "#*$%&|<>")
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    repeated = 0
    if n >= 4:
        w = word_hashes(raw, starts, ends)
        triple = mixed(mixed(w[:-2] * np.uint64(3) + w[1:-1]) * np.uint64(5) + w[2:])
        _, at, uses = np.unique(triple, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(uses[at] > 1)
        covered = np.zeros(n, dtype=bool)
        for i in range(3):
            covered[twice + i] = True
        repeated = int(covered.sum())
    return n, len(text) - spaces, marks, len(lines) - len(set(lines)), repeated


def quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles of a column in each group, to ``STEP``, and the group's rows n; the same however rows are dealt."""
    bins = rows.groupBy(by, F.floor(F.col(value) / STEP).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    # a group has no more bins than its values have steps, whatever its rows
    upto = F.sum("c").over(Window.partitionBy(by).orderBy("bin"))
    run = bins.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    return run.groupBy(by).agg(F.max("n").alias("n"), *[(F.min(F.when(F.col("upto") >= share * F.col("n"), F.col("bin"))) * STEP + STEP / 2).alias(name) for name, share in shares.items()])


def judged(docs: DataFrame, order: int = ORDER, band: float = BAND, labels: DataFrame | None = None, false_rejection: float = FALSE_REJECTION) -> DataFrame:
    """One row per document: base counts, log perplexity, band and verdicts.

    ``labels`` has doc_id and quality, 1 for clean documents.
    """
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    model = lambda h: F.concat(h.cast("string"), F.lit(":"), F.col("lang"))
    texts = docs.select("doc_id", lang.alias("lang"), half.alias("half"), "text")
    path, bits = stored(kneser_ney(counted(texts.select(model(F.col("half")).alias("model"), "text"), order), order))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = Models.shared(path, bits)

        def scored(held: list[tuple]) -> pd.DataFrame:
            rows = pd.DataFrame([(*r[0], r[1], *base_counts(r[3])) for r in held], columns=["no_id", "own_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
            sums, runs = np.zeros(len(held)), np.zeros(len(held))
            for name in {r[2] for r in held}:
                pieces, owner = [], []
                for i, r in enumerate(held):
                    if r[2] == name and rows["n_words"][i]:
                        own = padded(r[3], order, TOGETHER)
                        pieces += own
                        owner += [i] * len(own)
                if not pieces:
                    continue
                codes = symbols(pieces)
                at = windows(codes, order)
                logs = models.log_probabilities(name, codes, at, order)
                if logs is not None:
                    whose = np.repeat(owner, np.diff(np.flatnonzero(np.concatenate([[True], codes == 0]))))[at]
                    sums += np.bincount(whose, logs, len(held))
                    runs += np.bincount(whose, minlength=len(held))
            return rows.assign(log_ppl=pd.arrays.FloatingArray(-sums / np.maximum(runs, 1), runs == 0))

        held, size = [], 0
        for batch in batches:
            for no_id, own_id, own, name, text in zip(batch["no_id"], batch["own_id"], batch["lang"], batch["judge"], batch["text"], strict=True):
                held.append(((no_id, own_id), own, name, text or ""))
                size += len(text or "")
                if size >= TOGETHER or len(held) >= 4096:
                    yield scored(held)
                    held, size = [], 0
        if held:
            yield scored(held)

    seen = texts.select(*split_id(), "lang", model(1 - F.col("half")).alias("judge"), "text")
    scored = cut(seen.mapInPandas(run, schema="no_id boolean, own_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double")).withColumn("doc_id", whole_id())
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    marked = scored.withColumn("base_failed", failed)
    sound = marked.where(~F.col("base_failed") & F.col("log_ppl").isNotNull()).select("doc_id", "lang", "log_ppl")
    reach = (F.col("q3") - F.col("q1")) * band
    bands = quantiles(sound, "lang", "log_ppl", {"q1": 0.25, "q3": 0.75}).select("lang", (F.col("q1") - reach).alias("lower"), (F.col("q3") + reach).alias("upper"))
    if labels is not None:
        clean = labels.groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most")).where("least = 1 and most = 1")
        own = quantiles(sound.join(clean.select("doc_id"), "doc_id", "left_semi"), "lang", "log_ppl", {"s1": false_rejection / 2, "s2": 1 - false_rejection / 2})
        bands = bands.join(own.where(F.col("n") >= FEWEST_CLEAN), "lang", "left").select("lang", F.coalesce("s1", "lower").alias("lower"), F.coalesce("s2", "upper").alias("upper"))
    inside = F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(True))
    return marked.drop("no_id", "own_id").join(cut(bands), "lang", "left").withColumn("kept", ~F.col("base_failed") & inside)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.exp("log_ppl").alias("perplexity"))
