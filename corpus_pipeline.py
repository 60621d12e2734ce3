"""Training corpus from the documents table, in five stages.

Language ID drops what it rejects, line dedup cuts later copies of lines,
near-dedup keeps one document of each group, decontamination drops documents
with a benchmark passage, packing returns the pieces of packed sequences.
Every stage is written as Parquet to the shared folder and read again as the
next one's input, so a lost executor never reaches back over a stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, langid, linededup, minhash, packing
from cadenza.llm.common import drop, saved, table, work_paths
from cadenza.llm.registry import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the nearest-centroid model accepts."""
    return langid.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that an earlier line matches."""
    return linededup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each near-duplicate group."""
    gone = minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(saved(gone, "near-duplicates"), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 2048 ids.  An executor that has run the
    stages before has little memory left beside its heap, so tasks hold less here."""
    pieces = packing.pack(docs, tokenizer_path(), max_pieces=100_000, slice_bytes=1_000_000)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

# SQL cannot tokenize or train; tests compare run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        before = work_paths()
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        # the stage is written: what it was made from is not read again
        mine = [p for p in work_paths() if p not in before]
        drop(spark, kept + mine[:-1])
        kept = mine[-1:]
    return docs
