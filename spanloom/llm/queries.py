"""The registered queries of the training-data operators and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, chunks, hilbert, idfiles, line_templates, packing, quality_rules, simhash, site_quality, substrings
from spanloom.llm.common import documents
from spanloom.llm.tokens import vocabulary_path


def op1_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.rate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.line_digests(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).drop("row")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), vocabulary_path())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(documents(spark, sf_dir), width=3, bits=2)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.id_digests(documents(spark, sf_dir), vocabulary_path(), end_id=2)


def op7_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.fingerprint_edits(documents(spark, sf_dir))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digests(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary_path(), end_id=0, window=1024)


def op10_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.assign_shards(documents(spark, sf_dir), shards=40).drop("row")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_quality": op1_site_quality,
    "op2_line_templates": op2_line_templates,
    "op3_quality_rules": op3_quality_rules,
    "op4_bpe": op4_bpe,
    "op5_simhash": op5_simhash,
    "op6_id_files": op6_id_files,
    "op7_chunks": op7_chunks,
    "op8_substrings": op8_substrings,
    "op9_packing": op9_packing,
    "op10_hilbert": op10_hilbert,
}

#: The others are no plain SQL (tokenizers, rolling hashes, CRC-32, fitted models, a space-filling curve); tests/llm checks them
#: against brute force, exact round trips or held-out accuracy.
ORACLE_SQL: dict[str, str] = {"op2_line_templates": line_templates.DIGESTS_SQL}
