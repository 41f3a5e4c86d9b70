"""From documents to encoded training data: quality, line dedup, near-duplicates, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on every document that the stage before kept, and
returns a DataFrame; ``run`` writes each result as Parquet in the shared folder and reads it back as
the next stage's documents.  Rows may hold nulls and columns beyond those of documents, of any names;
these pass through all stages but the last.  Texts may be empty or of any length.  An empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hunkwise.llm import bpe, lines, minhash, mixing, quality, queries
from hunkwise.session import cut, ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject: null, empty and very short texts go; repeated rows stay or go together."""
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated and near-repeated lines out of the texts; every document stays, its text may become empty.

    Of equal lines the one of the least id stays, then of the least text key; rows equal in id and text
    are one document and keep the same lines.
    """
    return lines.drop_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the least id, then text key; of rows equal in both, one.

    Null and empty texts are one group.
    """
    return minhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as often as the mix takes it: not at all, once or twice; rows equal in id and text go alike."""
    return mixing.repeat_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of token ids) and whether decoding gives the text back; a null or empty text has no token."""
    encoded = bpe.round_trip(docs.select("doc_id", "text"), *queries.ranks())
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", encoding_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(ship(spark), docs, sf_dir), name.replace(" ", "-"))
    return docs
