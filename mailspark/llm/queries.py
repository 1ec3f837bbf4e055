"""The registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.llm import alignment, decontaminate, hard_negatives, language, lm, mixing, neighbours, secrets, simhash, spotsigs, token_files, toxicity, urls
from mailspark.llm.common import read


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a 13-word window of a benchmark item."""
    return decontaminate.contamination(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of each document under a hierarchical Pitman-Yor model, and under smoothed unigrams."""
    return lm.scores(spark, read(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document by segmentation-marginalised unigrams."""
    return language.languages(spark, read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SpotSigs fingerprints of each document and of its text edited with the next one's."""
    return spotsigs.fingerprints(spark, read(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by fixed patterns and by windowed entropy."""
    return secrets.secret_digest(read(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as Huffman-coded files and read back."""
    return token_files.token_table(spark, read(spark, sf_dir, "documents"), tokenizer_path())


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rules of the URL query: action, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block and allow decisions for pages, passed on to aliases."""
    return urls.verdicts(spark, read(spark, sf_dir, "pages"), URL_RULES)


#: Shares of the tokens grow as this power of what there is: small sources and languages are raised, topics stay.
MIX_POWER = {"source": 0.7, "lang": 0.8, "topic": 1.0}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weights of (source, language, topic) cells and the documents drawn by them."""
    return mixing.mix_table(spark, read(spark, sf_dir, "documents"), power=MIX_POWER)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of a factorization machine."""
    return toxicity.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of 3-word shingles and their classes at 2 differing bits."""
    return simhash.near_duplicates(spark, read(spark, sf_dir, "documents"), distance=2, shingle=3, seed=42)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; the label of every seventh is moved on by one first."""
    table = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(spark, table.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other vectors found for every hundredth one."""
    return neighbours.nearest(spark, read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, count=10)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of the tokens of a byte-level BPE and of a sentencepiece model."""
    return alignment.alignments(spark, read(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_lm, op3_language, op4_spotsigs, op5_secrets, op6_token_files, op7_urls, op8_mixing, op9_toxicity, op10_simhash,
        op11_hard_negatives, op12_neighbours, op13_alignment,
    )
}
