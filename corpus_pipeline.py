"""A corpus pipeline of the training-data operators: each stage works on all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import decontaminate, jaccard, langid, packing, pii
from tracewright.llm.queries import PSEUDONYM_KEY, VOCABULARY
from tracewright.llm.store import settle


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language by the model's score; with nothing learned, those with a letter."""
    return langid.identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8."""
    return jaccard.one_of_each(docs, k=5, p=80, q=100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't have a benchmark item's words in them."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by pseudonyms of the same format."""
    return pii.pseudonymised(docs, PSEUDONYM_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences of all documents in their batches."""
    return packing.packed(docs, VOCABULARY)


STAGES = [("language_id", identify), ("jaccard_join", near_copies), ("decontamination", decontaminated), ("pseudonyms", pseudonyms), ("packing", packed)]

#: Language models, pseudonyms and tokens can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``packing.packed`` for the documents under ``sf_dir`` that come through all stages.

    Null and empty texts, and those without a letter, go in the first stage. Of repeated rows of one id one stays; rows
    without an id stay, as no group can name them. With an empty benchmark none is contaminated; an empty table of
    documents gives no rows. Columns beyond those of ``documents``, whatever their names, are carried to the last stage,
    which returns its own. Ties are as the operators say.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
