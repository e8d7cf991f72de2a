"""Registered queries of the pipeline operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import (cotrain, decontaminate, hardneg, html_text, jaccard, langmix, lblm,
                            mixing, packing, repeats, rules, wavelet, whitening)
from foliospark.session import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = stored(wavelet.encode_shards(table(spark, sf_dir, "documents")), "wavelet")
    return wavelet.read_shards(shards)


@query
def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark"))


@query
def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_components(table(spark, sf_dir, "documents"))


@query
def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmix.identify(table(spark, sf_dir, "documents")).drop("mixture")


@query
def op6_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lblm.score_documents(table(spark, sf_dir, "documents"))


@query
def op5_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op5_risk_controlled_rules"] = rules.ORACLE


@query
def op7_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(table(spark, sf_dir, "documents"),
                            table(spark, sf_dir, "labels")).select("doc_id", "score", "kept")


@query
def op4_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mine(hardneg.labelled(table(spark, sf_dir, "embeddings")))


ORACLES["op12_hard_negatives"] = hardneg.ORACLE


@query
def op13_capped_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


ORACLES["op13_capped_mix"] = mixing.ORACLE


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
