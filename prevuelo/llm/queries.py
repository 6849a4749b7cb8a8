"""Registered queries of the operators for training data."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prevuelo.llm import bitpack, bpe, fim, imatch, neighbours, packing, pieces, pii, quality, repeats, simhash, spelling, toxicity
from prevuelo.llm.oracles import ORACLES
from prevuelo.llm.store import documents

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """A vocabulary file: below ``TOKENIZERS_DIR``, or where the box has the public ones."""
    root = os.environ.get("TOKENIZERS_DIR")
    if root:
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op1(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.op2(documents(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op3(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op4(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op5(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op6(documents(spark, sf_dir))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.op7(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.op8(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op9(documents(spark, sf_dir))


def op10_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.op10(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.op11(documents(spark, sf_dir))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.op12(documents(spark, sf_dir))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op13(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_repeats": op2_repeats,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_pii": op6_pii,
    "op7_neighbours": op7_neighbours,
    "op8_imatch": op8_imatch,
    "op9_simhash": op9_simhash,
    "op10_bitpack": op10_bitpack,
    "op11_fim": op11_fim,
    "op12_spelling": op12_spelling,
    "op13_pieces": op13_pieces,
}
__all__ = ["ORACLES", "QUERIES"]
