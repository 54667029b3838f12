"""A corpus pipeline: documents in one of the learned languages, without repeated passages or near copies, mixed to
target weights by source, and encoded. Each stage takes all rows that the one before returned, stored as Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillcheck.llm import bpe, langid, linededup, mixing, simhash
from quillcheck.llm.queries import split_pattern, vocabulary
from quillcheck.session import checkpoint_dir
from quillcheck.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in some learned language; those without letters or like no language go."""
    return langid.identified_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less later occurrences of three-line windows; n_chars follows the text. One of which nothing with a
    word stays goes."""
    return linededup.deduped_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked fingerprints; rows with null or repeated ids are told
    apart by their texts."""
    return simhash.first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, a document once for each time that it is taken."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row its doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    return bpe.round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"), split_pattern())


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("near_copies", drop_near_copies),
    ("mixture", mix_sources),
    ("byte_bpe", encode),
]

#: SQL has neither the automata of the first stage nor the merges of the last; tests hold the run against plain Python.
ORACLE_SQL = None


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a finished stage's folder, by Hadoop's own client so that any supported store works."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each stage's rows are stored in the shared checkpoint folder, until the next
    one's are."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop(spark, before)
        before = path
    return docs
