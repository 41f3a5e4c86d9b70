"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a 60-bit hash.  Per source, sizes are summed by the hash's leading 12 bits; the
running sum over these at most 4096 sums shows the bucket in which the budget ends.  Only that
bucket's rows are summed again by their next 12 bits, and so on.  The result is one threshold a
source: documents below it are taken.  Rows are never sorted, and after the first sum each step
reads about 1/4096 of the rows of the step before.

Thresholds nest: a larger budget of the same source takes a superset of the documents.  A source
whose target is above its size takes every document once and those below the threshold of the rest
a second time, so no document is taken more than twice.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hunkwise.session import cut, fresh

WORD = r"[^\x20\x09-\x0D]+"
BITS = (12, 12, 12, 24)
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of md5 over the id and the text's md5, the same on each run and partitioning."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to (source, source_size): a share of all sizes dealt by weight.

    Sources are ranked by code point, null last, and weigh ``weights`` in turn.  A target stops at
    ``most`` times its source's size and the excess is dealt again: with sources by rising
    size/weight, the capped ones are a prefix, so one running sum over the sources (one row each)
    finds the level that the others share.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    t = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    t = (
        t.withColumn("before", F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("budget", share * F.sum("source_size").over(every))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("w_left"))
    )
    # The first source that stays under its cap sets the level; all before it are capped.
    free = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("before", "level"))).over(every)
    t = t.withColumn("free", free["level"])
    return t.select("source", "source_size", F.when(F.col("free").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("free") * F.col("w"))).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame, bits=BITS) -> DataFrame:
    """(sid, bound): per source the hash below which sizes sum to its budget, as near as rows allow.

    rows: sid, h, size.  budgets: sid, budget.  A source whose budget takes every row has no bound.
    The row at the boundary goes in if that comes nearer to the budget.
    """
    left, total = 60, budgets.select("sid", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("under"), "budget")
    found = None
    for k, n in enumerate(bits):
        left -= n
        inside = rows if k == 0 else rows.join(total.select("sid", "prefix"), "sid").filter(F.shiftright("h", left + n) == F.col("prefix")).drop("prefix")
        sums = inside.groupBy("sid", F.shiftright("h", left).alias("bucket")).agg(F.sum("size").alias("size"))
        run = Window.partitionBy("sid").orderBy("bucket")
        full = (
            sums.join(total.select("sid", "under", "budget"), "sid")
            .withColumn("upto", F.col("under") + F.sum("size").over(run))
            .filter(F.col("upto") > F.col("budget"))
            .groupBy("sid", "budget")
            .agg(F.min(F.struct("bucket", F.col("upto").alias("upto"), "size")).alias("b"))
            .select("sid", F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.size")).alias("under"), "budget", F.col("b.upto").alias("upto"))
        )
        total = cut(full, "mix-level") if k < len(bits) - 1 else full
        found = total
    nearer = F.col("upto") - F.col("budget") < F.col("budget") - F.col("under")
    return found.select("sid", (F.col("prefix") + nearer.cast("long")).alias("bound"))


def source_id(source: Column) -> Column:
    """A key that tells null from every name."""
    return F.concat(F.when(source.isNull(), "-").otherwise("+"), F.coalesce(source, F.lit("")))


def bounds(rows: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(sid, source, source_size, target, whole, budget, bound), a row a source, of rows (source, size, h).

    Rows that are at hand as a table with ``sid`` are used as they are.

    A document is taken ``whole`` times, and once more where its hash is below ``bound`` (null: not).
    """
    if "sid" not in rows.columns:
        rows = cut(rows.select("size", "h", "source", source_id(F.col("source")).alias("sid")), "mix-rows")
    sizes = rows.groupBy("sid", "source").agg(F.sum("size").alias("source_size"))
    goal = cut(targets(sizes, weights, share, most).withColumn("sid", source_id(F.col("source"))), "mix-targets")
    # What a source takes beyond its whole size, or all that it takes if that is less.
    goal = goal.withColumn("whole", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("long"))
    goal = goal.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    bound = thresholds(rows.filter("size > 0"), goal.select("sid", "budget"))
    return cut(goal.join(bound, "sid", "left"), "mix-bounds")  # small: Spark broadcasts it if its file is


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, size, source_size, target, times, taken), a row for each document.

    Null text has size 0, a null source is a source of its own, ranked last.  Repeated rows (equal
    id and text) share a hash and are taken together or not at all.  An empty table gives no rows;
    columns other than doc_id, text and source are ignored, whatever their names.  Texts may be of any
    length: one that is longer than what is left of a target is taken if that comes nearer to it.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))
    rows = cut(rows.withColumn("sid", source_id(F.col("source"))), "mix-sizes")
    goal = bounds(rows, weights, share, most).drop("source")
    times = F.col("whole") + F.when(F.col("h") < F.col("bound"), 1).otherwise(0)
    out = rows.join(goal, "sid").withColumn("times", F.least(times, F.lit(int(most))).cast("long"))
    return out.select("doc_id", "h", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def repeat_documents(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The documents as often as ``mix`` takes them, with all their columns.

    A document without words has size 0 and goes like the others of its hash: its source's whole
    rounds, and once more below the threshold.  No join by id is made; a row's hash decides.
    """
    size, h = word_count(F.col("text")), row_hash(F.col("doc_id"), F.col("text"))
    plan = bounds(docs.select("doc_id", "source", size.alias("size"), h.alias("h")), weights, share, most)
    hash_, own, sid, whole, bound, n = fresh(docs, "_hash", "_own", "_sid", "_whole", "_bound", "_n")
    plan = plan.select(F.col("sid").alias(sid), F.col("whole").alias(whole), F.col("bound").alias(bound))
    rows = docs.withColumns({hash_: h, own: source_id(F.col("source"))}).join(plan, F.col(own) == F.col(sid), "left")
    times = F.least(F.coalesce(whole, F.lit(0)) + F.when(F.col(hash_) < F.col(bound), 1).otherwise(0), F.lit(int(most))).cast("int")
    return rows.withColumn(n, F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)
