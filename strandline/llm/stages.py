"""The stages of the corpus pipeline: functions of (spark, docs, sf_dir) over the columns of documents.

Cases: null and blank texts are rejected by the language stage (they have no letter); null doc_ids, repeated rows and extra columns
are carried along, extra columns of any name; an empty table stays empty. n_chars follows the text where there is such a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, line_dedup, mixing, near_dedup, packing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or strange to every language profile, go."""
    return language_id.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dedup.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or runs of their words, that the mix takes, a row for each repeat."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each text in a packed sequence."""
    return packing.pack(docs)
