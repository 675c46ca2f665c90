"""The corpus pipeline: each stage works on all that its predecessor kept, and its decisions take effect.

Sizes for the last stage are those of the texts that arrive there. Its `copies` says how often the mix takes a document;
documents that it does not take are gone.

Defined results: null and empty texts pass the quality, line and benchmark stages and are classes of their own in near-dedup;
the mix takes them or not by the share of their source, and they add no words. A text that line dedup empties stays as an
empty one. Null ids, sources and languages are values like others. Rows that repeat an id and a text share their fate, and
near-dedup leaves one of them; of a class the row with the smallest id stays, of rows alike in id and text any. Very long
texts are read whole. Without labels the quality stage keeps all; empty tables give an empty table with the columns of
documents and `copies`. Further columns pass through; one named copies is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import cube_mix, decontaminate, kneser_ney, line_dedup, order_minhash
from millrace.llm.common import read, saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kneser_ney.keep_good(docs, read(spark, sf_dir, "labels")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    out = out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.keep_one(docs).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cube_mix.mixed(docs).select(*(c for c in docs.columns if c != "copies"), "copies")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontaminate", benchmark), ("mix", mix)]

#: SQL cannot express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
