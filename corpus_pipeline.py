"""A training-corpus pipeline over `documents`: each stage works on all that the stage before it kept.

language: documents in no learned language, or without a letter, go; near_duplicates: one document of each group stays;
secrets: found secrets are masked in the texts; mixture: sources are repeated or thinned to their target weights;
packing: the documents become sequences of at most 1024 tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import langid, mixing, packing, secrets, simhash
from shelfspark.llm.common import free_name, table
from shelfspark.session import materialize


BATCH_ROWS = 1000  # texts that a Python worker is handed at once


def short_batches(spark: SparkSession) -> None:
    """From now on this session hands rows to Python at most BATCH_ROWS at a time, or fewer where it is set so.

    Of Spark's 10,000 whole texts the executor and the worker each hold a copy; results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents and drops those that the model rejects; all columns stay as they are.

    Null texts and texts without a letter are rejected; repeated rows are judged alike and stay repeated; rows with a null
    label are judged, not learned from."""
    short_batches(spark)
    model = langid.fit(docs.select("text", "lang"))
    names = tuple(free_name(docs.columns, n) for n in ("lang_pred", "score", "rejected"))
    judged = langid.predict(docs, model, docs.columns, names)
    return judged.filter(~F.col(names[2])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: one document of each group stays, that with the smallest doc_id.

    Texts without words, null or empty, are one group; rows that repeat wholly are one; a row with a null doc_id stays only
    where its group has no other."""
    short_batches(spark)
    return simhash.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported secret becomes a mark; n_chars follows the text.  No document goes: null texts stay null (n_chars null),
    empty ones empty, and repeated rows are masked alike."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0 to 3 times.

    Null and empty texts have no words and are not taken; a null source is a source of its own; rows that repeat
    wholly share what is taken of them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences; each row of a repeated document is packed, a null or empty text as its end token alone."""
    short_batches(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_duplicates", near_duplicates), ("secrets", mask_secrets), ("mixture", mixture), ("packing", pack)]

ORACLE_SQL = None  # models, fingerprints and tokens are beyond SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
