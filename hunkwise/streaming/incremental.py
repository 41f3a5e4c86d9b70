"""Analyses of pairs as their hunk files arrive.

The engine's inputs are finite; a stream here is a folder that gets new hunk files.  Each micro-batch
holds whole files, and a pair's analysis needs only its own rows, so every batch is a small run of the
batch operators and its rows are appended.  A file that is seen again by a restarted query falls into
the same batch, which overwrites that batch's folder: results stand once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from hunkwise.sources import text


def arriving_lines(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of (path, value): whole files below ``path``, as they come."""
    read = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch)
    return read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))


def split_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line) of (path, value)."""
    return files.select("path", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("line_no", "line"))


def follow(spark: SparkSession, path: str, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = text.parse_hunks, once: bool = False) -> StreamingQuery:
    """Runs ``work`` on the lines of each batch of new files and writes its rows to ``out/batch=<n>`` as Parquet.

    With ``once`` it ends when all present files are done.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(split_lines(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = arriving_lines(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()
