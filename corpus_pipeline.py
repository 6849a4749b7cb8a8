"""The corpus pipeline: toxic documents go, one of each group of near copies stays, repeated passages go, personal data
is replaced, and what is left is packed into sequences. Every stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prevuelo.llm import packing, pii, repeats, simhash, toxicity
from prevuelo.llm.queries import tokenizer
from prevuelo.llm.store import documents, free, written

#: No stage but the last can be said in SQL: labels are learned from and hashes are not DuckDB's.
ORACLE_SQL = None


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` follows the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar scores below 0.3."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of fingerprints that link at 4 or fewer bits."""
    return simhash.keep_one(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that start anywhere else too; emptied documents stay."""
    kept = free(docs, "kept")
    found = repeats.dedup(docs, characters=True)
    return _counted(found.withColumn("text", F.col(kept).cast("string")), docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data under pseudonyms."""
    return _counted(pii.pseudonymise(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences."""
    return packing.op4(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", clean),
    ("simhash", distinct),
    ("repeats", unrepeated),
    ("pii", private),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
