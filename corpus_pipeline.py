"""The corpus pipeline: toxicity, near-duplicates, repeated passages, mixing, packing.

Each stage takes all documents that the one before it kept and, but for the last, returns rows with
the columns of ``documents``. Near-duplicates are taken on five-word shingles at a similarity of
0.8. No stage is expressed in SQL as a whole, so there is no oracle; the tests hold small runs
against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import toxicity as tox
from cuelake.llm.common import columns_of, saved, table
from cuelake.llm.mixing import mixed
from cuelake.llm.near_dedup import NearDedup, drop_near
from cuelake.llm.packing import Packing, packed
from cuelake.llm.queries import vocabulary
from cuelake.llm.substring_dedup import deduplicated


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that score 0.5 or more; the model learns from ``labels``.

    Each row is judged by its own text: null and empty texts stay, repeated rows stay or go together,
    extra columns of any name pass through. An empty table stays empty.
    """
    model = tox.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(F.struct(*columns_of(docs)).alias("doc_id"), "text")
    judged = tox.toxicity(scored, model)
    return judged.where("score < 0.5").select("doc_id.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id (of equal ones, the smallest hash of its text).

    Texts that are null, empty or without words, and rows without doc_id, stay. Rows that repeat a
    doc_id and its text are one document and stay or go together. Extra columns pass through.
    """
    return drop_near(docs, NearDedup(words=5, num=80, den=100))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has too are taken out of the text.

    All rows stay. Null and empty texts stay as they are, a null doc_id counts as the largest, rows that
    repeat a doc_id and its text are shortened alike. ``n_chars``, if there, tells the new length; all
    other columns pass through, whatever their names.
    """
    short = deduplicated(docs)
    if "n_chars" in docs.columns:
        short = short.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return short


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come as often as their source's target weight takes them.

    A null text has no words and takes its source's rate; a null source is a source. Rows with one
    doc_id share their draw. Extra columns pass through.
    """
    return mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 4096.

    A null text counts as empty and gives its closing token alone. Repeated rows are packed each.
    Extra columns are not read. An empty table gives no pieces.
    """
    pieces = packed(docs, Packing(vocabulary()))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stage's rows being written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
