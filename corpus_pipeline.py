"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm.bpe import bpe_encode
from schemaloom.llm.common import materialise, release
from schemaloom.llm.decontaminate import decontaminate
from schemaloom.llm.line_dedup import line_dedup
from schemaloom.llm.near_dup import near_dup_components
from schemaloom.llm.quality import quality
from schemaloom.llm.queries import public_vocabulary, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps. Null and empty texts are scored like any other; repeated rows fare alike."""
    return quality(docs, table(spark, sf_dir, "labels")).where("keep").select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their frequent lines; n_chars follows the text. Null texts come back empty."""
    out = line_dedup(docs)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity 0.8 or more): the one with the
    smallest id, with all rows that repeat it. Rows without an id stay."""
    gone = near_dup_components(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark. One passage leaks its item, however long the document around it is, so
    op3's share of a twentieth isn't asked for here. Null and empty texts hold none and stay, as repeated rows do."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the digests of ids and decoded text. Null and empty texts have no tokens."""
    path, pattern = public_vocabulary()
    return bpe_encode(docs, path, pattern)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", encode_stage),
]

#: The first stage is a fitted model, which SQL can't express; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read by the next, then deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, before = materialise(stage(spark, docs, sf_dir), f"stage-{name}"), docs
        release(before)
    return docs
