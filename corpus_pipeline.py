"""The corpus pipeline: language ID, near-dedup, decontamination, secret scan, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. A row is a document, whether its doc_id is null, repeated or not; null texts, ties, repeated rows
and extra columns behave as the stages' operators document.
"""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from offerlens.llm import decontaminate, langid, neardup, pieces, secrets
from offerlens.llm.common import bounded, read, saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _bounded(stage):
    """The stage with small Arrow batches: an executor's memory holds one of each task, in the JVM and in the worker."""

    @functools.wraps(stage)
    def run(spark, docs, sf_dir):
        bounded(spark)
        return stage(spark, docs, sf_dir)

    return run


def language(spark, docs, sf_dir):
    """Drop documents without a letter; lang becomes the network's prediction, learned from the labelled rows."""
    net = langid.train(docs.select("doc_id", "text", "lang"))
    return langid.keep_spoken(docs.select(*COLUMNS), net)


def dedup(spark, docs, sf_dir):
    """Keep one document of each near-duplicate class: that of its least doc_id, else its first row."""
    return neardup.keep_one(docs).select(*COLUMNS)


def decontamination(spark, docs, sf_dir):
    """Drop documents that hold part of a benchmark text."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secret_scan(spark, docs, sf_dir):
    """Mask every secret found; the document stays, its n_chars follows."""
    return secrets.mask_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sentencepiece(spark, docs, sf_dir):
    """Piece ids of every document."""
    return pieces.encode_pieces(docs)


STAGES = [(name, _bounded(stage)) for name, stage in [("language", language), ("dedup", dedup), ("decontamination", decontamination), ("secrets", secret_scan), ("sentencepiece", sentencepiece)]]
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each one's result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
