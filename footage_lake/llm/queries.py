"""The numbered queries over whole tables, and DuckDB text where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from footage_lake.llm import bpe, fingerprint, hmm, main_text, packing, personal, quality_rules, secrets, simhash, spelling, token_counts, toxicity, whitening
from footage_lake.llm.common import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_report(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.toxicity_report(documents, toxicity.learn(documents, table(spark, sf_dir, "labels")))


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scored(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = quality_rules.learn_rules(documents, table(spark, sf_dir, "labels"))
    return quality_rules.quality_report(documents, rules)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_report(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return personal.personal_report(documents, personal.learn(documents))


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_fingerprints": op2_fingerprints,
    "op3_packing": op3_packing,
    "op4_token_counts": op4_token_counts,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_hmm": op7_hmm,
    "op8_bpe": op8_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_main_text": op10_main_text,
    "op11_spelling": op11_spelling,
    "op12_whitening": op12_whitening,
    "op13_personal": op13_personal,
}

ORACLE: dict[str, str] = {}
