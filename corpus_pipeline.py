"""A training-data pipeline over ``documents``: stages of (name, function), each on the rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailspark.llm import decontaminate, mixing, simhash, token_files, toxicity
from mailspark.llm.common import read, stored
from mailspark.llm.queries import MIX_POWER, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at the threshold or above go."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays, the one with the smallest id."""
    return simhash.deduplicated(spark, docs, distance=2, shingle=3, seed=42)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lies in benchmark windows go."""
    return decontaminate.decontaminated(spark, docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources and languages have their target shares of the tokens."""
    return mixing.sampled(spark, docs, power=MIX_POWER)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left; returns each document's place in them."""
    return token_files.token_table(spark, docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", write_tokens),
]

#: Fingerprint hashes and learned scores are not SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each result written to the scratch folder and read back for the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name.replace(" ", "-").replace("/", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
