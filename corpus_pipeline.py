"""Training-data pipeline: toxicity, quality, near-duplicates, mixing and tokens, each stage written before the next reads it."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import mixing, near_copies, quality, sentencepiece_codec, toxicity
from cadenza.llm.common import write_shared

#: Tokenizer model of the last stage; set it to another path as needed.
_TOKENIZERS = importlib.util.find_spec("public_tokenizers")
PIECE_MODEL = f"{_TOKENIZERS.submodule_search_locations[0] if _TOKENIZERS else '/opt/tokenizers'}/piece_bpe_32k.model"
TOXICITY = 0.3
QUALITY = 0.3
TARGETS = mixing.TARGETS


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those whose toxicity score reaches the threshold."""
    return toxicity.drop_toxic(docs, _labels(spark, sf_dir), TOXICITY)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality reaches the threshold."""
    return quality.keep_good(docs, _labels(spark, sf_dir), QUALITY)


def keep_first_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash links from vantage-point shards and wide codes, five-word shingles at a similarity of 0.8."""
    return near_copies.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated at the rates that meet the target weights."""
    return mixing.mix(docs, _labels(spark, sf_dir), TARGETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang and the tokens of every document that is left."""
    rows = sentencepiece_codec.encode_documents(docs, PIECE_MODEL)
    return rows.select("doc_id", "source", "lang", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("simhash", keep_first_copy),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: No SQL expresses the fitted models; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
