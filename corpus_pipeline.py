"""The corpus pipeline; part of the llm subpackage.

Five stages, each on all that the one before kept. A stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

SQL cannot express the byte model, the fingerprints, the tagger or the tokens, so there is no ORACLE_SQL; the stages are tested
against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import language, packing, personal, quality, similar
from loomgraph.llm.texts import free
from loomgraph.session import staged, table

#: Documents whose language is less sure than this are rejected.
LEAST_SURE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or are far from every language."""
    return quality.passed(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language. Learns from the documents that aren't held out."""
    languages = language.train(docs.where(language.remainder(F.col("doc_id")) != 2))
    names = tuple(free(x, docs.columns) for x in ("found", "sure", "bits"))
    return language.predict(docs, languages, names=names).where((F.col(names[0]) != language.UNKNOWN) & (F.col(names[1]) >= LEAST_SURE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, a similarity of 0.8 or more. Candidates are operator 8's classes and, beyond its reach, shared MinHash bands."""
    return similar.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; n_chars follows the text."""
    return personal.mask(docs, personal.train(docs)).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("SimHash near-dedup", near_duplicates), ("PII", personal_data), ("best-fit packing", best_fit_packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
