"""The queries of the operators in this subpackage, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hunkwise.llm import bpe, gif, licences, lines, minhash, mixing, passages, quality, secrets, sharding
from hunkwise.session import ship


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def ranks(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    """The rank file of a public vocabulary and its splitting pattern."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(_documents(spark, sf_dir))
    return out.select("doc_id", "class_id", "group_id", "keep")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(_documents(spark, sf_dir).select("doc_id", "text"), *ranks()))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_documents(spark, sf_dir))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(_documents(spark, sf_dir))


def op8_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_digests(_documents(spark, sf_dir))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_decisions(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("passages", lambda x: F.concat_ws("-", x["start"], x["end"]))
    return passages.passage_classes(_documents(spark, sf_dir)).withColumn("passages", F.array_join(spans, ","))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_near_duplicates, op3_bpe, op4_mix, op5_quality, op6_shard, op7_licences, op8_gif, op9_lines, op10_passages)}
