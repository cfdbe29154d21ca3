"""From documents to shards of training text: rejects go, one of each group of near copies stays, documents that share a
span with the benchmark go, sources are mixed to their weights, and what is left is dealt to shards of equal bytes."""

from pyspark.sql import DataFrame, SparkSession

from factwright.llm import minhash, mixing, resample, sharding, winnow
from factwright.session import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what importance resampling draws towards good, harmless text."""
    return resample.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies: five-word shingles, similarity 0.8."""
    return minhash.deduplicate(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share ten words in a row, or a shorter whole item, with the benchmark."""
    return winnow.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes sources by weights 1, 2, 3, repeating, up to three times; a document taken twice is there twice."""
    return mixing.mix(docs, (1, 2, 3), 3)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot: eight shards of near equal bytes."""
    return sharding.shard(docs, 8)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: Hashes of n-grams and minima are not SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
