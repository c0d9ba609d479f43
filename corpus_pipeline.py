"""The corpus pipeline: toxicity, near duplicates, benchmark passages, secrets, mixing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; `run` writes each
result as Parquet in the shared folder and rereads it. All but the last stage return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import decontam, jaccard, secrets, toxicity
from wayfold.llm.common import Scratch, checkpointed, deleted, shared_folder, table, word_count
from wayfold.llm.queries import mixed


def beside(docs: DataFrame) -> DataFrame:
    """The text beside the whole row, so that no column of docs clashes with one that an operator adds."""
    return docs.select(F.struct(*docs.columns).alias("__row"), F.col("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't judged toxic. Null and empty texts are not toxic unless all texts are; rows without a label are judged, too."""
    model = toxicity.fit(checkpointed(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"))))
    return toxicity.severity(beside(docs), model).filter("NOT toxic").select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more.

    The smallest doc_id stays (a null one last, then a hash of the row decides); texts without words all stay.
    """
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up less than the contract's share; null and empty texts stay."""
    found = decontam.find_contamination(beside(docs), table(spark, sf_dir, "benchmark"))
    return found.filter(~decontam.contaminated()).select("__row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars brought up to date; null texts stay null."""
    return secrets.redact(docs, secrets.train_models(docs), length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size and how many of its words the mix takes (repeats counted)."""
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mixed(sizes).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        with Scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            deleted(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


#: Toxicity and the shingle join have no SQL form; tests compare each stage with a plain version of it.
ORACLE_SQL = None
