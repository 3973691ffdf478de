"""A corpus from raw documents: STAGES in order, each reading what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import bpe, decontaminate, jaccard, pii, quality
from folioforge.llm.common import fresh, stored, table
from folioforge.llm.queries import QUALITY_CUT, word_bpe_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, fitted on the labelled ones among them, does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    mark = fresh(docs, "score")
    return quality.score(docs, model, name=mark).where(F.col(mark) >= QUALITY_CUT).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of near copies.

    Rows with a null doc_id stay; of repeated rows with one doc_id the first by text, source and language stays.
    """
    groups = stored(jaccard.join(docs).where("doc_id = component_id").select("doc_id").distinct())
    once = docs.where("doc_id IS NOT NULL").join(groups, "doc_id", "left_semi")
    rest = sorted((c for c in docs.columns if c != "doc_id"), key=lambda c: c != "text")
    row = fresh(docs, "_r")
    first = once.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias(row))
    return first.select("doc_id", f"{row}.*").select(*docs.columns).union(docs.where("doc_id IS NULL"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; n_chars follows the new text."""
    rest = tuple(c for c in docs.columns if c != "doc_id")
    held = {c: fresh(docs, c) for c in rest if c in ("base", "more")}  # names that the operator's own columns have
    found = pii.find(docs.withColumnsRenamed(held), keep=tuple(held.get(c, c) for c in rest))
    found = found.withColumn("text", pii.redacted(F.col("text"), F.concat("base", "more"))).drop("base", "more").withColumnsRenamed({v: k for k, v in held.items()})
    if "n_chars" in rest:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the decoded text of every document that is left."""
    return bpe.tokenize(docs, word_bpe_path())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("tokens", tokens_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written to the shared folder and read again.

    Null and empty texts go through as empty ones, as far as the quality stage keeps them; rows with a null doc_id belong
    to no group and no item and stay; repeated rows with one doc_id become one; columns of any name come along up to
    the last stage; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
