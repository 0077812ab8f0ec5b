"""Corpus pipeline: language ID, line dedup, near-dedup, mixing and packing over the documents table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepbank.llm import langid, lines, mixing, packing, simhash
from prepbank.llm.common import table
from prepbank.llm.registered import tokenizer_path
from prepbank.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; the model is learned from a bounded sample of the labelled ones."""
    return langid.drop_unknown(docs, langid.fit(docs, F.lit(True)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a document's source go; every document stays."""
    return lines.drop_boilerplate(docs, "source", "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of SimHash fingerprints (3-word shingles, at most 3 differing bits) the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.repeat_documents(docs, mixing.mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in the training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]

# Language ID, fingerprints and packing have no SQL form; tests/llm/test_pipeline.py holds run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents; each result is written and read back before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
