"""A training corpus from raw documents: language, quality, near-duplicates, mix, sequences.

Each stage works on all rows the one before kept.  A stage is written to the shared folder and
read again, so a lost executor costs a stage's tasks at most.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.llm import langid, mixing, packing, quality, simhash
from mailrisk.llm.shared import settled


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones teach."""
    found = langid.identify(docs)
    return found.where(langid.recognised(found)).select("row.*")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where(F.col("predicted") == 1).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints of four-word shingles within four bits."""
    return simhash.without_copies(docs, words=4, bits=4)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language", language),
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("sequences", sequences),
]

# automata, classifiers, tokenizers and shingle hashes are no SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
