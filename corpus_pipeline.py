"""A corpus from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept, and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawfinder.llm.common import WORD, cut, table
from lawfinder.llm.linededup import deduplicated
from lawfinder.llm.neardup import ROW, linked_rows, with_row_key
from lawfinder.llm.packing import pack
from lawfinder.llm.secrets import redacted
from lawfinder.llm.toxicity import THRESHOLD, with_toxicity


def apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as one, so that their names never meet those that a stage uses."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(None).cast("string").alias("no other")).alias("other columns"))


def together(found: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, with the values of ``changed`` where they have such columns."""
    return found.select(*[changed.get(c, F.col(c) if c in ("doc_id", "text") else F.col("other columns")[c]).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic. Labels of all rows teach the classifier; rows without text or label are scored like others, and an empty table stays empty."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    scored = with_toxicity(apart(docs), labels)
    return together(scored.where(F.col("score") < THRESHOLD), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of lines; those left without words by it go; rows without text stay, and n_chars follows a changed text."""
    found = deduplicated(apart(docs))
    kept = found.where((F.size("deleted_lines") == 0) | F.col("text").rlike(WORD))
    if "n_chars" not in docs.columns:
        return together(kept, docs)
    changed = F.when(F.size("deleted_lines") > 0, F.length("text").cast("long")).otherwise(F.col("other columns")["n_chars"])
    return together(kept, docs, n_chars=changed)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group of near duplicates, and every row without words."""
    # Dropped rows grow with the documents: they meet in a shuffle, at any size.
    dropped = linked_rows(docs.select("doc_id", "text")).where("not kept").select(ROW).distinct().hint("merge")
    alone = F.when(F.col("text").rlike(WORD), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id())
    keyed = with_row_key(apart(docs)).withColumn("alone", alone)
    return together(keyed.join(dropped, ROW, "left_anti").dropDuplicates([*ROW, "alone"]), docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked; a null text stays null, and n_chars follows the text."""
    return together(redacted(apart(docs)), docs, n_chars=F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents, with their token ids; a null text counts as empty."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: Learned scores, hash minima and tokenizers have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
