"""Documents to packed training sequences: five stages, each a Parquet table that the next one reads."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.llm import mixing, packing, pii, rules, shingles
from strandline.llm.common import Scratch, swept, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the rules' model rejects go."""
    return rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: fingerprints propose, whole sets of five-word shingles confirm, and a prefix filter finds what 4 bits miss.

    Links are exactly the pairs of Jaccard similarity 0.8 or more; of each component the document of least id stays.
    """
    return shingles.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: confirmed spans become their kind in brackets; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: a row for each time that the mix takes a document."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the pieces of all rows in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("PII", personal_data), ("mixing sources", mix), ("packing", pack)]

#: The rules' model and the components can't be stated in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with swept():
            docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
