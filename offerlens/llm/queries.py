"""The training-data operators as queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from offerlens.llm import license_scan, preference, vptree
from offerlens.llm.common import read
from offerlens.llm.decontaminate import contaminated
from offerlens.llm.langid import language_id
from offerlens.llm.neardup import near_duplicates
from offerlens.llm.packing import pack
from offerlens.llm.pieces import encode_pieces
from offerlens.llm.secrets import scan_secrets
from offerlens.llm.toxicity import toxicity


def op1_near_duplicates(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"))


def op3_decontaminate(spark, sf_dir):
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_preference(spark, sf_dir):
    pairs = preference.format_pairs(preference.sampled_rejections(read(spark, sf_dir, "conversations")))
    return pairs.withColumns({c: preference.as_text(F.col(c)) for c in ("chosen_loss", "rejected_loss")})


def op5_toxicity(spark, sf_dir):
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_language(spark, sf_dir):
    return language_id(read(spark, sf_dir, "documents"))


def op7_secrets(spark, sf_dir):
    return scan_secrets(read(spark, sf_dir, "documents"))


def op8_pieces(spark, sf_dir):
    return encode_pieces(read(spark, sf_dir, "documents"))


def op9_licenses(spark, sf_dir):
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op10_neighbours(spark, sf_dir):
    return vptree.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_packing": op2_packing,
    "op3_decontaminate": op3_decontaminate,
    "op4_preference": op4_preference,
    "op5_toxicity": op5_toxicity,
    "op6_language": op6_language,
    "op7_secrets": op7_secrets,
    "op8_pieces": op8_pieces,
    "op9_licenses": op9_licenses,
    "op10_neighbours": op10_neighbours,
    "pipeline": pipeline,
}
ORACLE_SQL: dict[str, str] = {"op4_preference": preference.ORACLE, "op9_licenses": license_scan.oracle(), "op10_neighbours": vptree.ORACLE}
