"""The corpus pipeline: raw documents to packed training sequences.

Each stage works on all that the stage before kept and returns the columns of
``documents``, with ``n_chars`` counted anew, but for the last, whose rows are the
pieces of sequences. ``run`` writes each stage's result as Parquet in the shared
folder and reads it back as the next one's documents; a result that the next stage's
written one replaces is deleted, and so are the tables that a stage's result reads
(``held``) once it is written.

Rows with the same doc_id share the verdicts of quality and of near-duplicates: they
stay if all of them pass. A document that a stage empties goes; one that was empty
before goes by the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm import common, lines, near_dup, packing, quality, suffix_dedup
from changeflow.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def kept_only(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The documents all of whose rows in ``verdicts`` (doc_id, kept) are kept."""
    ok = verdicts.groupBy("doc_id").agg(F.min("kept").alias("kept")).filter("kept").select(F.col("doc_id").alias("ok_id"))
    return docs.select(*COLUMNS).join(ok, F.col("doc_id").eqNullSafe(F.col("ok_id")), "left_semi")


def with_text(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source",
                       F.char_length(text).cast("long").alias("n_chars")).filter("text <> ''")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, held: common.Scratch | None = None) -> DataFrame:
    return kept_only(docs, quality.quality_rules(docs).select("doc_id", "kept"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, held: common.Scratch | None = None) -> DataFrame:
    return with_text(lines.dedup_lines(docs, keep=("lang", "source")), "text")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, held: common.Scratch | None = None) -> DataFrame:
    """Texts are shuffled once, into a table bucketed by doc_id: neither the candidates' join
    nor the one with the verdicts moves them again. Rows without a doc_id, which the operator
    links with nothing and keeps, stay as they are."""
    docs, held = docs.select(*COLUMNS), held or common.Scratch(spark, "near-dup-docs")
    named = held.bucketed(docs.filter("doc_id is not null").repartition("doc_id"), "docs", ["doc_id"])
    verdicts = near_dup.near_duplicates(named)
    ok = verdicts.groupBy("doc_id").agg(F.min("kept").alias("kept")).filter("kept").select("doc_id")
    return named.join(ok, "doc_id", "left_semi").select(*COLUMNS).unionByName(docs.filter("doc_id is null"))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, held: common.Scratch | None = None) -> DataFrame:
    return with_text(suffix_dedup.dedup_passages(docs, with_text=True, keep=("lang", "source"), held=held), "kept")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, held: common.Scratch | None = None) -> DataFrame:
    return packing.pack_documents(docs, vocabulary()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("suffix_dedup", passage_stage),
    ("packing", packing_stage),
]

#: SQL can't tokenize; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = common.read_table(spark, sf_dir, "documents").select(*COLUMNS), None
    for name, stage in STAGES:
        written, held = (common.Scratch(spark, f"{kind}-{name}") for kind in ("stage", "held"))
        docs = written.saved(stage(spark, docs, sf_dir, held), "docs")
        held.drop()
        if read:
            read.drop()
        read = written
    return docs
