"""From raw documents to a training mix: STAGES in order, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import aside, saved, table
from heliograph.llm.contamination import clean
from heliograph.llm.jaccard import deduplicated
from heliograph.llm.mixing import mix_sources
from heliograph.llm.pii import redact
from heliograph.llm.toxicity import scored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go.

    Null and empty texts score as a text without words, rows without an id are judged by their text, repeated rows alike. Very long
    texts are read whole."""
    docs, back = aside(docs, "tox_score")
    return back(scored(docs, table(spark, sf_dir, "labels")).filter("tox_score < 0.5").drop("tox_score"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of the Jaccard join hold together, the one with the least id stays.

    Null and empty texts link with nothing and stay, as do rows without an id; rows that share an id are told apart by their sets,
    and of repeated rows one stays."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item go.

    Null and empty texts and items hold nothing; rows without an id and repeated rows are judged each by their text."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data is replaced by its kind; n_chars, if there is one, follows the text.

    A null text stays null and has no length; rows are judged one by one, so repeated ones change alike, and all stay."""
    done = redact(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources come near their targets.

    A null source is one of its own; a text without words adds nothing and is drawn as others are; repeated rows are drawn alike. The
    columns are those of the input and mix_copy, which counts a document's copies from 0."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("mixing", mixing),
]

#: A trained classifier decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
