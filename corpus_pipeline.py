"""The corpus pipeline: toxicity, near-duplicates, personal data, mixing and packing, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return docs' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelbase.llm import mixing, near_copies, packing, pii, toxicity
from reelbase.llm.common import new_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the detector doesn't reject; it is trained on the labelled rows of the original table."""
    return toxicity.clean(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose sets of five-word shingles have a similarity of 0.8 or more.

    By SimHash and the generalised pigeonhole, checked on whole sets; what fingerprints leave apart is joined exactly.
    """
    return near_copies.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of rarer sources up to one and a half times as often."""
    return mixing.mix(docs, repetition_limit=1.5)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 2048 tokens."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained networks and tokenizers can't be expressed in SQL: stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and reread as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
