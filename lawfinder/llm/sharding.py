"""Sharding by balanced label propagation.

Documents that share a link key are neighbours. Linked documents start evenly
dealt; in each round every one looks at how many neighbours each shard holds
and asks to move to the best. Moves are granted under quotas: as many between
two shards as ask both ways, and beyond that what the target has free. At the
end documents without neighbours fill each shard exactly to its quota, so row
counts differ by at most one, whatever the links.

All counts are kept per (link, shard), never per pair, so a key may link any
share of the rows; one that exceeds a shard's quota spreads over as many
shards as it needs.

Defined cases: a null text counts as empty; empty texts are equal texts;
repeated rows are placed each; a document with a null link has no neighbours;
an empty table gives no rows; further columns are ignored. Rows are dealt to
tasks by id, link and a number of their own, so null or repeated ids gather
nowhere, whatever their share.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_cut, numbered, table

SHARDS = 16
ROUNDS = 12
#: Rounds end when twice in a row no more than this share of the linked rows moves.
SETTLED = 0.002


def granted(asked: np.ndarray, free: np.ndarray) -> np.ndarray:
    """How many of the moves asked from each shard (row) to each (column) are granted."""
    out = np.minimum(asked, asked.T)
    room = free.astype(np.int64).copy()
    for target in range(len(free)):
        rest = asked[:, target] - out[:, target]
        total = rest.sum()
        if total and room[target] > 0:
            more = rest * min(room[target], total) // total
            left = min(room[target], total) - more.sum()
            for source in np.argsort(-(rest - more), kind="stable"):
                extra = min(left, rest[source] - more[source])
                more[source] += extra
                left -= extra
            out[:, target] += more
    np.fill_diagonal(out, 0)
    return out


def _order() -> list[Column]:
    """What rows are numbered by; the last tells rows of one id and link apart."""
    return [F.col("doc_id"), F.col("link"), F.col("__row")]


def _buckets(rows: int) -> int:
    """Hash buckets in which rows are numbered, of about half a million rows each."""
    return max(256, rows // 500_000)


def _grid(rows: list, shards: int) -> np.ndarray:
    out = np.zeros((shards, shards), dtype=np.int64)
    for r in rows:
        out[r["shard"], r["target"]] = r["n"]
    return out


def _loads(rows: DataFrame, shards: int) -> np.ndarray:
    out = np.zeros(shards, dtype=np.int64)
    for r in rows.groupBy("shard").count().collect():
        out[r["shard"]] = r["count"]
    return out


def propagated(linked: DataFrame, quota: np.ndarray, rounds: int) -> DataFrame:
    """Shards of linked rows after label propagation under quotas."""
    shards, size = len(quota), max(1, int(quota.min()))
    total = linked.count()
    index = numbered(linked, [], _order(), "at", buckets=_buckets(total))
    state = cut(index.withColumn("shard", (F.col("at") % shards).cast("int")).drop("at"))
    quiet = 0
    for number in range(rounds):
        free = quota - _loads(state, shards)
        open_to = F.array(*[F.lit(bool(f > 0 or number % 2 == 0)) for f in free])
        held = state.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
        each = F.struct("n", F.xxhash64("link", "shard").alias("tie"), "shard")
        around = cut(held.groupBy("link").agg(F.sort_array(F.collect_list(each), asc=False).alias("all")))
        joined = state.join(around, "link")
        # A key too large for one shard is drawn to as many open ones as its rows there need.
        room = F.filter("all", lambda s: F.element_at(open_to, s["shard"] + 1))
        needed = F.ceil(F.aggregate(room, F.lit(0).cast("long"), lambda n, s: n + s["n"]) / F.lit(size)).cast("int")
        best = F.slice(room, F.lit(1), needed)
        own = F.filter("all", lambda s: s["shard"] == F.col("shard"))[0]
        stays = (F.size("best") == 0) | F.exists("best", lambda s: s["shard"] == F.col("shard"))
        goal = F.element_at("best", F.pmod(F.xxhash64("doc_id", "__row", F.lit(number)), F.greatest(F.size("best"), F.lit(1))).cast("int") + 1)
        full = ~F.element_at(open_to, F.col("shard") + 1)
        better = (F.struct(F.col("goal.n"), F.col("goal.tie")) > F.struct(own["n"], own["tie"])) | (full & (F.col("goal.n") >= own["n"]))
        target = F.when(stays | ~better, F.col("shard")).otherwise(F.col("goal.shard"))
        wishes = joined.withColumn("best", best).withColumn("goal", F.when(F.size("best") > 0, goal)).withColumn("target", target)
        asked = cut(wishes.drop("all", "best", "goal"))
        counts = _grid(asked.groupBy("shard", "target").agg(F.count(F.lit(1)).alias("n")).collect(), shards)
        np.fill_diagonal(counts, 0)
        allowed = granted(counts, free)
        quiet = quiet + 1 if allowed.sum() <= SETTLED * total else 0
        if quiet == 2:  # one round of each kind
            break
        movers = numbered(asked.where("shard != target"), ["shard", "target"], _order(), "rank")
        limit = F.element_at(F.array(*[F.lit(int(x)) for x in allowed.ravel()]), F.col("shard") * shards + F.col("target") + 1)
        moved = movers.withColumn("shard", F.when(F.col("rank") < limit, F.col("target")).otherwise(F.col("shard"))).drop("rank", "target")
        old, state = state, cut(asked.where("shard = target").drop("target").unionByName(moved))
        for done in (old, asked, around):
            drop_cut(done)
    return state


def balanced_shards(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows that have doc_id and a long ``link``.

    Row counts of shards differ by at most one; ``slot`` numbers the rows of
    a shard from 0 in a fixed order.
    """
    base = cut(rows.withColumn("__row", F.monotonically_increasing_id()))
    total = base.count()
    quota = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    several = cut(base.where("link is not null").groupBy("link").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("link"))
    linked = propagated(base.join(several, "link", "left_semi"), quota, rounds)
    alone = base.join(several, "link", "left_anti")
    left = np.cumsum(quota - _loads(linked, shards))
    index = numbered(alone, [], _order(), "at", buckets=_buckets(total))
    shard: Column = F.lit(shards - 1)
    for s in range(shards - 2, -1, -1):
        shard = F.when(F.col("at") < int(left[s]), F.lit(s)).otherwise(shard)
    filled = index.withColumn("shard", shard).drop("at")
    placed = linked.select(*base.columns, "shard").unionByName(filled.select(*base.columns, "shard"))
    return numbered(cut(placed), ["shard"], _order(), "slot", buckets=_buckets(total // shards)).drop("__row")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("link")
    )
    found = balanced_shards(rows)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
