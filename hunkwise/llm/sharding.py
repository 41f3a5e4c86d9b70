"""Sharding by a Feistel permutation over global row numbers.

Rows get global numbers 0..n-1 in the order of their key columns.  A Feistel network over the least
even number of bits that holds n permutes these numbers; a value outside 0..n-1 walks on along its
cycle until it falls inside, which makes it a permutation of exactly 0..n-1.  Position p belongs to
shard ``p mod shards``, slot ``p div shards``.  Shards therefore differ by one row at most, slots
have no gaps, and anyone who knows n and the key computes a row's shard and slot, or the row at a
slot by the inverse permutation, without a table.

Only narrow rows are shuffled (id, size, checksum); texts stay where they are read.  The order's
last column differs between rows, so a range boundary can pass through equal keys and no key fills
a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hunkwise.session import cut

ROUNDS = 4
M = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _half_bits(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _keys(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _network(x: np.ndarray, half: int, keys, back: bool) -> np.ndarray:
    h, low = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = x >> h, x & low
    with np.errstate(over="ignore"):
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (_mix(left + k) & low), left
            else:
                left, right = right, left ^ (_mix(right + k) & low)
    return left << h | right


def permute(x: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The place of row numbers ``x`` among ``n``, or with ``back`` the row at a place."""
    x, half, keys = x.astype(np.uint64), _half_bits(n), _keys(seed)
    out = _network(x, half, keys, back)
    while (outside := np.flatnonzero(out >= np.uint64(n))).size:
        out[outside] = _network(out[outside], half, keys, back)
    return out.astype(np.int64)


def number_rows(rows: DataFrame, order: list[str], parts: int | None = None) -> tuple[DataFrame, int]:
    """Adds ``row_no``, 0..n-1 in ``order``; nulls come first, equal rows in any order among themselves.

    The sorted rows are written once with their partition and place in it; the counts of the
    partitions (a row each) then give every partition its offset.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = tied.repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    placed = cut(placed.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(counts.select("_part", before.alias("_before"), "_n"), "offsets")
    n = offsets.agg(F.sum("_n")).first()[0] or 0
    return placed.join(offsets.drop("_n"), "_part").withColumn("row_no", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before"), n


def shard_rows(rows: DataFrame, order: list[str], shards: int = 16, seed: int = 0) -> DataFrame:
    """Adds ``row_no``, ``place``, ``shard`` and ``slot`` to rows (which should be narrow).

    An empty table gives no rows; fewer rows than shards leave some shards empty.  Repeated rows
    are rows of their own.  Names among the added ones are replaced.
    """
    numbered, n = number_rows(rows.drop("row_no", "place", "shard", "slot"), order)

    @F.arrow_udf("long")
    def place(v: pa.Array) -> pa.Array:
        return pa.array(permute(v.to_numpy(zero_copy_only=False), n, seed))

    out = numbered.withColumn("place", place("row_no"))
    return out.withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", F.floor(F.col("place") / shards).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for documents, under the law ``rows``.

    Documents are numbered by id, then checksum and size.  A null text has size 1 and checksum 0; a
    null id comes before all others.  Repeated rows have numbers of their own; an empty table gives no
    row.  Texts may be of any length; columns other than doc_id and text are ignored, whatever their
    names.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard_rows(narrow, ["doc_id", "text_crc32", "size"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
