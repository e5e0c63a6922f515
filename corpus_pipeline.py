"""Corpus pipeline: drop toxic documents, repeated passages, near copies and benchmark leaks, then pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
read again as the next one's ``docs``.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from journeyloom.llm.common import table
from journeyloom.llm.decontaminate import contaminated
from journeyloom.llm.hmm_lm import remainder
from journeyloom.llm.jaccard_join import jaccard_join
from journeyloom.llm.line_dedup import dedup_lines, document_key, with_bitmap
from journeyloom.llm.packing import pack_documents
from journeyloom.llm.toxicity import score_texts, train
from journeyloom.sources.workspace import drop_frames, results_folder, watched_frames

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_scratch: dict[str, list[str]] = {}


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is not among ``ids``; rows without a doc_id stay, rows that share one go together."""
    gone = ids.where("doc_id is not null").select(F.col("doc_id").alias("_doc")).distinct()
    carried = docs.select(document_key(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = with_bitmap(carried, gone).where("not _marked")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored under one half stay; trained on the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    # Trained on the stage's own input: the labelled documents it still has.
    chain = train(docs, labels)
    carried = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("_rest"))
    kept = score_texts(carried, chain).where("score < 0.5")
    return kept.select(*[F.col(c if c in ("doc_id", "text") else f"_rest.`{c}`").alias(c) for c in docs.columns])


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts; rows stay, and n_chars follows the text."""
    clean = dedup_lines(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or near texts the one with the smallest doc_id stays.

    Texts without words are equal.  Rows without a doc_id stay.
    """
    return _without(docs, jaccard_join(docs).where("doc_id <> group_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return pack_documents(docs)


def _tidy(name: str, stage: Stage) -> Stage:
    """Scratch of the stages before goes when a stage begins: their results have been written by then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for earlier in [k for k in _scratch if k.startswith(f"{spark.sparkContext.applicationId}/")]:
            drop_frames(spark, _scratch.pop(earlier))
        with watched_frames() as frames:
            out = stage(spark, docs, sf_dir)
        _scratch[f"{spark.sparkContext.applicationId}/{name}"] = frames
        return out

    return run


STAGES: list[tuple[str, Stage]] = [
    (name, _tidy(name, stage))
    for name, stage in (
        ("toxicity", drop_toxic),
        ("line_dedup", dedup_passages),
        ("jaccard_join", drop_near_copies),
        ("decontaminate", drop_leaks),
        ("packing", pack_sequences),
    )
]
# Trained models, tokenizers and hashes of chunks have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    folder = f"{results_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
