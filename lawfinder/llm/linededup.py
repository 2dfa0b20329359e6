"""Line deduplication by winnowing over line hashes.

A gram is the shortest run of lines, from each line on, with ``GRAM`` words
or more. Among the grams that start within a window of ``REACH - GRAM`` words
the one of least hash is a fingerprint, so that any two equal runs of lines
with ``REACH`` words share one at the same place.

Fingerprints of equal hash are matched both ways. What stands with a
fingerprint is written as keys: one for it and each next line behind it, and
one for each next line before it. A key's first occurrence is its source, and
any other one repeats it, whatever document the source is in; so a match goes
on as far as any earlier occurrence does, not only as far as the first. Lines
up to ``REACH`` words beyond the fingerprint's line are looked at; within a
longer repeat the next fingerprint stands among them and goes on. So each
repeat of ``REACH`` words goes whole; of shorter ones (``GRAM`` words or more)
those go whose fingerprints meet. Documents are in order of doc_id.

Everything is DataFrame expressions: there is no Python on the rows.

Defined cases: lines without words are no units, and go with a run that
encloses them; a null or empty text has no lines with words and stays as it
is; a run may repeat inside its own document, of which the first stays; rows
that repeat doc_id and text are one document and change alike; rows without
doc_id take no part and stay as they are; an empty table gives no rows; further columns pass through unchanged, but for columns named as the
two added ones, which those replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, bound, cut, table

#: Words of the shortest repeat that counts, and of the shortest that is always found.
GRAM, REACH = 10, 50

_HASH = "__dedup_text_hash"
_NODE = ["doc_id", _HASH]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(_HASH, F.xxhash64("text"))


def _placed(docs: DataFrame) -> DataFrame:
    """The lines with words of each document: pos, hash h, words w, and words before it s."""
    lines = _keyed(docs).select(*_NODE, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    units = lines.select(*_NODE, "pos", F.xxhash64("line").alias("h"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("w")).where("w > 0 and doc_id is not null")
    dealt = units.repartition(*_NODE).dropDuplicates([*_NODE, "pos"])
    before = Window.partitionBy(*_NODE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("s", F.sum("w").over(before) - F.col("w"))


def fingerprints(at: DataFrame, gram: int = GRAM, reach: int = REACH) -> DataFrame:
    """doc_id, text hash, pos and hash g of each fingerprint of the placed lines, how many lines it has, and the lines after and before."""
    inside = Window.partitionBy(*_NODE)
    span = lambda a, b: inside.orderBy("s").rangeBetween(a, b)
    line = F.struct("h", "pos")
    grams = at.select(
        *_NODE, "pos", "s",
        F.when(F.sum("w").over(span(0, gram - 1)) >= gram, F.xxhash64(F.collect_list("h").over(span(0, gram - 1)))).alias("g"),
        F.count("w").over(span(0, gram - 1)).cast("int").alias("lines"),
        line.alias("line"), F.collect_list(line).over(span(0, reach)).alias("here"), F.collect_list(line).over(span(-reach, -1)).alias("before"),
    )
    low = F.min(F.when(F.col("g").isNotNull(), F.struct("g", "pos"))).over(span(0, reach - gram))
    # What the next line has before it in reach starts where this line, however long, ends.
    behind = F.coalesce(F.lead("here").over(inside.orderBy("s")), F.array().cast("array<struct<h:bigint,pos:int>>"))
    picked = grams.select(*_NODE, "pos", "g", "lines", "before", F.concat(F.array("line"), behind).alias("after"), low.alias("low"))
    wins = picked.where("low is not null").select(*_NODE, F.col("low.pos").alias("pos")).distinct()
    return picked.drop("low").where("g is not null").join(wins, [*_NODE, "pos"])


def contexts(found: DataFrame) -> DataFrame:
    """One row per fingerprint and line it may reach: its place, the key of all between them, that line (edge), and the side."""
    back = F.reverse("before")
    key = lambda side, lines, k: F.xxhash64("g", F.lit(side), F.transform(F.slice(lines, F.lit(1), k), lambda x: x["h"]))
    row = lambda side, lines, k: F.struct(key(side, lines, k).alias("key"), F.element_at(lines, k)["pos"].alias("edge"), F.lit(side).alias("side"))
    ahead = F.transform(F.sequence("lines", F.size("after")), lambda k: row(1, F.col("after"), k))
    behind = F.when(F.size("before") > 0, F.transform(F.sequence(F.lit(1), F.size("before")), lambda k: row(0, back, k)))
    every = F.concat(ahead, F.coalesce(behind, F.array().cast("array<struct<key:bigint,edge:int,side:int>>")))
    return found.select(*_NODE, "pos", F.inline(every))


def repeated_runs(at: DataFrame, gram: int = GRAM, reach: int = REACH) -> DataFrame:
    """The later runs: doc_id, text hash, first and last line, and the doc_ids that hold earlier occurrences."""
    found = cut(fingerprints(at, gram, reach))
    several = cut(found.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"))
    around = cut(contexts(found.join(several, "g", "left_semi")))
    place = F.struct(*_NODE, "pos")
    firsts = around.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = around.join(cut(firsts.select("key", "first")), "key").where(place != F.col("first"))
    ahead, back = F.when(F.col("side") == 1, F.col("edge")), F.when(F.col("side") == 0, F.col("edge"))
    source = F.col("first.doc_id")
    return later.groupBy(*_NODE, "pos").agg(
        F.coalesce(F.min(back), F.col("pos")).alias("first_line"), F.max(ahead).alias("last_line"),
        F.array_compact(F.array(F.max_by(source, ahead), F.min_by(source, back))).alias("sources"),
    ).where("last_line is not null").drop("pos")


def deduplicated(docs: DataFrame, gram: int = GRAM, reach: int = REACH) -> DataFrame:
    """Documents with their later repeated runs removed.

    Adds ``deleted_lines`` (positions) and ``source_ids`` (documents that hold
    the first occurrences), both sorted and empty where nothing repeats.
    """
    docs = docs.drop("deleted_lines", "source_ids")
    runs = cut(repeated_runs(cut(_placed(docs)), gram, reach))
    # Runs overlap: each adds the lines beyond those before it.
    before = Window.partitionBy(*_NODE).orderBy("first_line", "last_line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest(F.col("first_line"), F.max("last_line").over(before) + 1)
    fresh = runs.withColumn("start", start).withColumn("fresh", F.when(F.col("start") <= F.col("last_line"), F.sequence("start", "last_line")))
    gone = fresh.groupBy(*_NODE).agg(
        F.array_sort(F.flatten(F.collect_list("fresh"))).alias("deleted_lines"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("source_ids"),
    )
    # What is deleted grows with the documents: it meets them in a shuffle, at any size.
    joined = _keyed(docs).join(cut(gone).hint("merge"), _NODE, "left").drop(_HASH)
    lines = F.split("text", "\n")
    rest = bound(
        F.struct(lines.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("deleted_lines")).alias("kept")),
        lambda v: F.array_join(F.transform(v["kept"], lambda i: F.element_at(v["lines"], i + 1)), "\n"),
    )
    return joined.select(
        *[c for c in docs.columns if c != "text"],
        F.when(F.col("deleted_lines").isNull(), F.col("text")).otherwise(rest).alias("text"),
        F.coalesce("deleted_lines", F.array().cast("array<int>")).alias("deleted_lines"),
        F.coalesce("source_ids", F.array().cast("array<long>")).alias("source_ids"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("deleted_lines").cast("long").alias("n_deleted"), "deleted_lines", "source_ids", F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))
