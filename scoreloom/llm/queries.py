"""The queries of the operators in this package, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe as op8
from . import fim as op11
from . import html_extract as op4
from . import importance as op5
from . import langid as op3
from . import media as op9
from . import packing as op10
from . import phrases as op12
from . import quality_rules as op1
from . import simhash as op7
from . import suffixes as op13
from . import toxicity as op2
from . import wordpiece as op6
from .common import new_path, table


def op1_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op1.quality_rules(docs).drop("text")


def op2_toxicity(spark, sf_dir):
    return op2.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark, sf_dir):
    return op3.identify(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark, sf_dir):
    return op4.extract(table(spark, sf_dir, "pages"))


def op5_quality_classifier(spark, sf_dir):
    return op5.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark, sf_dir):
    return op6.token_counts(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark, sf_dir):
    return op7.near_duplicates(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark, sf_dir):
    return op8.bpe_digests(table(spark, sf_dir, "documents"))


def op9_media_columns(spark, sf_dir):
    return op9.media_columns(table(spark, sf_dir, "documents"), new_path(spark, "media"))


def op10_best_fit_packing(spark, sf_dir):
    return op10.pack(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark, sf_dir):
    out = op11.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = {"output_sha256": F.sha2(F.col("output").cast("binary"), 256), "restored_sha256": F.sha2(op11.restored(F.col("output"), F.col("form")).cast("binary"), 256)}
    return out.withColumns(digests).drop("output")


def op12_phrase_collocations(spark, sf_dir):
    return op12.collocations(table(spark, sf_dir, "documents"))


def op13_suffix_array_dedup(spark, sf_dir):
    out = op13.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_token_counts": op6_token_counts,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_media_columns": op9_media_columns,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
}
ORACLES = {"op1_quality_rules": op1.oracle_sql(), "op11_fill_in_middle": op11.oracle_sql(), "op12_phrase_collocations": op12.oracle_sql()}
