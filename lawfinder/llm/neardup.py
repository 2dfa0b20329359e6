"""Join of documents whose word n-grams are alike, by a MinHash LSH forest.

Each document's set of 5-word shingles gets one label per tree: a string of
minima, a byte each, of independent hash functions. Documents whose labels in
some tree begin alike share a node of that tree's prefix trie. Prefixes start
long and are shortened step by step:

* At the longest prefix, documents that share nodes form teams, and those of a
  team are compared with each other.
* At each shorter one, only nodes that hold several teams count. There a pair
  of different teams is compared where it shares its first node, so once.

Comparisons are exact, on the sets. The similarities found say how many links
a prefix length misses: one of similarity s is met with the probability
1 - (1 - s**depth)**trees. Shortening ends when the share found is estimated
to reach the target, and a pair at the threshold is met with at least
``SURE``.

Defined cases: a null text or one without words has no shingles and links
with nothing; a text of fewer than five words has one shingle of all its
words; documents of equal sets form one copy class that is compared once and
counted fully; rows are told apart by doc_id and text, so that rows of one or
of no doc_id with different texts are judged each by its text; rows that
repeat doc_id and text count as copies; a class without any doc_id has a null
id; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, numbered, table
from .textstats import mixed, shingle_hashes, word_bounds, word_hashes

WORDS = 5
THRESHOLD = 0.8
TREES = 32
#: Lengths of prefixes, longest first.
DEPTHS = (10, 7, 6, 5, 4, 3)
TARGET_RECALL = 0.9999
#: Least probability that a pair at the threshold is met, whatever is estimated.
SURE = 0.999
#: Documents of a node or team that are compared with as many others in one step.
BLOCK = 256

_rng = np.random.default_rng(77)
_SCALE = (_rng.integers(0, 1 << 31, TREES * DEPTHS[0], dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, TREES * DEPTHS[0], dtype=np.uint32)


def met(similarity: float, depth: int, trees: int) -> float:
    """The probability that labels of two sets begin alike in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    return np.unique(shingle_hashes(word_hashes(raw, *word_bounds(raw)), k))


def labels(shingles: np.ndarray) -> list[bytes]:
    """One label per tree: the lowest byte of each minimum."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_SCALE), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(low, (x[at : at + 2048, None] * _SCALE + _SHIFT).min(axis=0), out=low)
    return [row.tobytes() for row in low.astype(np.uint8).reshape(TREES, DEPTHS[0])]


#: What tells rows apart: the doc_id, 0 where there is none, and 128 bits of the text.
ROW = ["no_id", "own_id", "t1", "t2"]


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``ROW``, none of them null; ordered by doc_id, rows without one last."""
    return docs.withColumns({
        "no_id": F.col("doc_id").isNull(), "own_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")),
        "t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), F.col("text")),
    })


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, row key, the 128-bit identity of its shingle set (null without words), and its labels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            high, low, keys = [], [], []
            for text in batch["text"]:
                s = shingle_set(text, k)
                if len(s):
                    high.append(int(s.sum().view(np.int64)))
                    low.append(int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)))
                    keys.append(labels(s))
                else:
                    high.append(None)
                    low.append(None)
                    keys.append(None)
            yield pd.DataFrame({**{c: batch[c] for c in ROW}, "high": pd.array(high, dtype="Int64"), "low": pd.array(low, dtype="Int64"), "keys": keys})

    found = with_row_key(docs).select(*ROW, "text").mapInPandas(run, schema="no_id boolean, own_id long, t1 long, t2 long, high long, low long, keys array<binary>")
    return found.withColumn("doc_id", F.when(~F.col("no_id"), F.col("own_id")))


def compared(texts: list[str], weights: np.ndarray, may: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compare the pairs that ``may`` marks, on their sets.

    Returns the weights linked to each text, the first text of its linked
    group, and how many links have each hundredth of similarity.
    """
    sets = [shingle_set(t, k) for t in texts]
    sizes = np.array([len(s) for s in sets])
    n = len(sets)
    values, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = uses[column] > 1
    place = np.cumsum(uses > 1) - 1
    row, column = row[shared], place[column[shared]]
    common = np.zeros((n, n), dtype=np.float32)
    width = 16384
    for at in range(0, int((uses > 1).sum()), width):
        inside = (column >= at) & (column < at + width)
        grid = np.zeros((n, min(width, int((uses > 1).sum()) - at)), dtype=np.float32)
        grid[row[inside], column[inside] - at] = 1
        common += grid @ grid.T
    likeness = common.astype(np.float64) / np.maximum(sizes[:, None] + sizes[None, :] - common.astype(np.float64), 1)
    alike = (likeness >= threshold) & may
    found = np.bincount(np.minimum(likeness[np.triu(alike)] * 100, 100).astype(np.int64), minlength=101)
    first = np.arange(n)
    while True:
        lower = np.minimum(first, np.where(alike, first[None, :], n).min(axis=1))
        lower = lower[lower]
        if (lower == first).all():
            return alike @ weights, first, found
        first = lower


_WEIGH = np.random.default_rng(78).integers(1, 1 << 63, DEPTHS[0], dtype=np.uint64) | np.uint64(1)


def shared_nodes(keys: list[list[bytes]], depth: int, trees: int) -> np.ndarray:
    """Which pairs share a node of that depth in one of the first ``trees`` trees."""
    own = np.frombuffer(b"".join(b"".join(k[:trees]) for k in keys), np.uint8).reshape(len(keys), trees, DEPTHS[0])
    prefix = (own[:, :, :depth].astype(np.uint64) * _WEIGH[:depth]).sum(axis=2, dtype=np.uint64)
    out = np.zeros((len(keys), len(keys)), dtype=bool)
    for one in prefix.T:
        out |= one[:, None] == one[None, :]
    return out


_UNIT = ["tree", "node", "part_a", "part_b"]


def _verify(rows: DataFrame, k: int, threshold: float, depth: int, longer: int | None) -> DataFrame:
    """Compare the documents of each unit; rows come sorted by unit.

    A unit is a team (without ``longer``), or a node of which pairs count
    that are of two teams, share no node in an earlier tree, and shared none
    at the ``longer`` prefix. Returns rows (rep, linked, hub), and rows (bin,
    n) with the number of links of each similarity.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(block: list[tuple]) -> pd.DataFrame:
            seen = {b[4]: b for b in block}
            ids = sorted(seen)
            held = [seen[i] for i in ids]
            sides, teams = np.array([b[6] for b in held]), np.array([b[7] for b in held])
            may = sides[:, None] != sides[None, :] if len(np.unique(sides)) > 1 else ~np.eye(len(ids), dtype=bool)
            if longer is not None:
                keys = [b[8] for b in held]
                may &= teams[:, None] != teams[None, :]
                may &= ~(shared_nodes(keys, depth, held[0][0]) | shared_nodes(keys, longer, TREES))
            use = np.flatnonzero(may.any(axis=1))
            if not len(use):
                return pd.DataFrame({"rep": [], "linked": [], "hub": [], "bin": [], "n": []}).astype("Int64")
            weights = np.array([held[i][5] for i in use], dtype=np.int64)
            linked, first, found = compared([held[i][9] for i in use], weights, may[np.ix_(use, use)], k, threshold)
            on = np.flatnonzero(linked)
            links = pd.DataFrame({"rep": [ids[use[i]] for i in on], "linked": linked[on], "hub": [ids[use[first[i]]] for i in on]}, dtype="Int64")
            bins = pd.DataFrame({"bin": np.flatnonzero(found), "n": found[found > 0]}, dtype="Int64")
            return pd.concat([links, bins]).reindex(columns=["rep", "linked", "hub", "bin", "n"]).astype("Int64")

        block: list[tuple] = []
        for batch in batches:
            for r in batch.itertuples(index=False, name=None):
                if block and block[0][:4] != r[:4]:
                    yield done(block)
                    block = []
                block.append(r)
        if block:
            yield done(block)

    sorted_rows = rows.repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    return sorted_rows.select(*_UNIT, "rep", "copies", "part", "team", "keys", "text").mapInPandas(run, schema="rep long, linked long, hub long, bin long, n long")


def _units(members: DataFrame, pool: DataFrame, block: int) -> DataFrame:
    """Members (tree, node, rep, team) with their texts, dealt to units of two parts of ``block`` at most; parts of one and the same team are left out of shorter prefixes."""
    node = ["tree", "node"]
    placed = cut(numbered(members, node, [F.col("team"), F.col("rep")], "at").withColumn("part", F.floor(F.col("at") / block).cast("int")).drop("at"))
    parts = cut(placed.groupBy(*node, "part").agg(F.min("team").alias("least"), F.max("team").alias("most")))
    other = parts.select(*[F.col(c).alias(f"o_{c}") for c in node], F.col("part").alias("other"), F.col("least").alias("o_least"), F.col("most").alias("o_most"))
    same = F.least("least", "o_least") == F.greatest("most", "o_most")
    pairs = parts.join(other, (F.col("tree") == F.col("o_tree")) & (F.col("node") == F.col("o_node"))).where((F.col("tree") < 0) | ~same)
    units = placed.join(cut(pairs.select(*node, "part", "other")), [*node, "part"])
    return units.select(*node, F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"), "part", "rep", "team").join(pool, "rep")


def _pool(docs: DataFrame, classes: DataFrame, depth: int) -> DataFrame:
    """Texts and labels of the classes that share a node of that depth with another."""
    leaves = classes.select("rep", F.posexplode("keys").alias("tree", "label")).select("rep", "tree", F.substring("label", 1, depth).alias("node"))
    several = leaves.groupBy("tree", "node").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("tree", "node")
    mates = cut(leaves.join(cut(several), ["tree", "node"], "left_semi").select("rep").distinct())
    # A class has one text: rows that repeat its key are one before they meet it.
    shown = with_row_key(docs).select(*ROW, "text").dropDuplicates(ROW)
    return cut(shown.join(classes.join(mates, "rep").select("row.*", "rep", "copies", "keys"), ROW).select("rep", "copies", "keys", "text"))


def forest_links(docs: DataFrame, classes: DataFrame, k: int, threshold: float, target: float, block: int) -> DataFrame:
    """Exact links of classes (rep, row, copies, keys), as rows (rep, linked, hub)."""
    found: list[DataFrame] = []
    bins: dict[int, int] = {}
    surely = next((d for d in DEPTHS if met(threshold, d, TREES) >= target), DEPTHS[-1])
    pool, pooled = _pool(docs, classes, surely), surely
    teams = longer = None
    for depth in DEPTHS:
        if depth < pooled:
            pool, pooled = _pool(docs, classes, depth), depth
        leaves = pool.select("rep", F.posexplode("keys").alias("tree", "label")).select("rep", "tree", F.substring("label", 1, depth).alias("node"))
        if teams is None:
            nodes = cut(leaves.groupBy("tree", "node").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last"))
            groups = components(leaves.join(nodes, ["tree", "node"]).select("rep", "hub"), "rep", "hub")
            teams = cut(groups.select(F.col("node").alias("rep"), F.col("component").alias("team")))
            members = teams.select(F.lit(-1).alias("tree"), F.col("team").cast("string").cast("binary").alias("node"), "rep", "team")
        else:
            own = cut(leaves.join(teams, "rep", "left").withColumn("team", F.coalesce("team", "rep")))
            nodes = own.groupBy("tree", "node").agg(F.min("team").alias("least"), F.max("team").alias("most")).where("least < most")
            members = own.join(cut(nodes.select("tree", "node")), ["tree", "node"], "left_semi")
        links = cut(_verify(_units(cut(members), pool, block), k, threshold, depth, longer))
        found.append(links.where("rep is not null").select("rep", "linked", "hub"))
        for r in links.where("bin is not null").groupBy("bin").agg(F.sum("n").alias("n")).collect():
            bins[r["bin"]] = bins.get(r["bin"], 0) + r["n"]
        every = sum(n / met(max(b / 100, threshold), depth, TREES) for b, n in bins.items())
        if met(threshold, depth, TREES) >= min(SURE, target) and sum(bins.values()) >= target * every:
            break
        longer = depth
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def linked_rows(docs: DataFrame, k: int = WORDS, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, block: int = BLOCK) -> DataFrame:
    """The columns of :func:`near_duplicates` and ``ROW`` for each row, and whether it stays.

    Of the rows linked with one another those of the smallest row key stay,
    and all rows without words.
    """
    sketch = cut(sketches(docs, k))
    known = sketch.where(F.col("low").isNotNull())
    least = known.groupBy("high", "low").agg(F.min(F.struct(*ROW)).alias("row"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))
    # Classes are numbered as they are written, so that their numbers stay.
    classes = cut(least.withColumn("rep", F.monotonically_increasing_id()))
    links = forest_links(docs, classes, k, threshold, target_recall, block)

    joined = cut(components(links, "rep", "hub").select(F.col("node").alias("rep"), F.col("component").alias("hub")))
    stays = joined.join(classes.select("rep", "row"), "rep").groupBy("hub").agg(F.min("row").alias("stays"))
    linked = joined.join(cut(stays), "hub").select("rep", "stays")
    counts = links.groupBy("rep").agg(F.sum("linked").alias("linked"))
    facts = cut(
        classes.select("high", "low", "rep", "row", "copies").join(linked, "rep", "left").join(counts, "rep", "left").select(
            "high", "low", "row", F.coalesce("stays", "row").alias("stays"),
            (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        )
    )
    own = lambda r: F.when(~F.col(r)["no_id"], F.col(r)["own_id"])
    found = known.drop("keys").join(facts, ["high", "low"]).select(
        "doc_id", own("row").alias("copy_of"), own("stays").alias("class_id"), "n_links", *ROW, (F.struct(*ROW) == F.col("stays")).alias("kept")
    )
    bare = sketch.where(F.col("low").isNull()).select(
        "doc_id", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), *ROW, F.lit(True).alias("kept")
    )
    return found.unionByName(bare)


def near_duplicates(docs: DataFrame, k: int = WORDS, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, copy_of, class_id and n_links.

    ``copy_of`` is the smallest doc_id with the same shingle set, ``class_id``
    the smallest doc_id reachable over links, ``n_links`` the number of other
    documents whose Jaccard similarity is at least ``threshold``.
    """
    return linked_rows(docs, k, threshold, target_recall, block).select("doc_id", "copy_of", "class_id", "n_links")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
