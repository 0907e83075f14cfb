"""Corpus pipeline: five stages from raw documents to sampled token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of documents.

Defined results: a stage treats nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns as the operator that it calls says in its
own docstring; a document that no stage rejects reaches the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontamination, minhash, quality, sampled_pieces, secrets
from tickloom.llm.common import Workspace, table

#: SQL cannot express the model, the lexer and the sampler; tests/llm holds the stages against brute force.
ORACLE_SQL = None
PIECES = "piece_bpe_32k.model"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), Workspace(spark, "pipeline-quality"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the smallest doc_id stays."""
    return minhash.deduplicate(docs, Workspace(spark, "pipeline-minhash"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontamination.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; all documents stay."""
    return secrets.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled piece ids of every text, and whether they decode to it."""
    import public_tokenizers

    made = sampled_pieces.encode(docs.select("doc_id", "text"), public_tokenizers.path(PIECES))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "lossless")


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("SentencePiece encoding and decoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    place = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = place.write(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
