"""Queries of the training-data operators and the SQL of those that DuckDB can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from cadenza.llm import fill_in_middle, minhash, mixing, pseudo_likelihood, quality, sentencepiece_codec, sharding, simhash, sql, tiff, token_alignment, toxicity, url_filter, word_bpe

#: Tokenizer model of op7; a path that Spark or Python can open.
PIECE_MODEL = corpus_pipeline.PIECE_MODEL
#: Tokenizer files of op11 and op12, beside it.
BYTE_BPE, WORD_BPE = (PIECE_MODEL.rpartition("/")[0] + name for name in ("/byte_bpe_50k.json", "/word_bpe_49k.json"))

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"), 8)


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_digest(_read(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score_documents(_read(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_digest(_read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.token_digest(_read(spark, sf_dir, "documents"), PIECE_MODEL)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.page_outcomes(pages, _read(spark, sf_dir, "labels")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_digest(_read(spark, sf_dir, "documents"), BYTE_BPE, PIECE_MODEL)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.token_digest(_read(spark, sf_dir, "documents"), WORD_BPE)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.transform_digest(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_sharding": op2_sharding,
        "op3_tiff": op3_tiff,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_minhash": op5_minhash,
        "op6_quality": op6_quality,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_simhash": op8_simhash,
        "op9_mixing": op9_mixing,
        "op10_url_filter": op10_url_filter,
        "op11_token_alignment": op11_token_alignment,
        "op12_bpe": op12_bpe,
        "op13_fill_in_middle": op13_fill_in_middle,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": sql.OP2_SHARDING, "op10_url_filter": sql.OP10_URL_FILTER, "op13_fill_in_middle": sql.OP13_FILL_IN_MIDDLE}
