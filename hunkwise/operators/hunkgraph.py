"""The graph of definition parts: a node for each (definition, hunk) on each side.

sub rows: pair_id, variant, sub_id, node_key, dcb_id, diff_type, file, start, end, seq, desc_key.
edges: pair_id, variant, src, dst (sub_ids; the source needs the target).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hunkwise.operators.intervals import FILE, hunk_sides

SIDE = ["pair_id", "variant"]


def sub_nodes(mapped: DataFrame, painted: DataFrame, hunks: DataFrame) -> DataFrame:
    """A part for each mapped (node, hunk): the node's whole range cut to the hunk, numbered by the hunk's start."""
    n = painted.select(*FILE, "node_key", F.col("start").alias("n0"), F.col("end").alias("n1"), "desc_key")
    h = hunk_sides(hunks).select("pair_id", "variant", "dcb_id", "diff_type", "h_start", "h_end")
    rows = mapped.join(n, [*FILE, "node_key"]).join(h, ["pair_id", "variant", "dcb_id"])
    w = Window.partitionBy(*SIDE, "node_key").orderBy("h_start", "dcb_id")
    return rows.select(
        *SIDE, F.concat_ws("|", "variant", F.col("node_key").cast("string"), F.col("dcb_id").cast("string")).alias("sub_id"), "node_key", "dcb_id", "diff_type", "file",
        F.greatest("n0", "h_start").alias("start"), F.least("n1", "h_end").alias("end"), F.row_number().over(w).cast("long").alias("seq"), "desc_key",
    )


def chain_edges(sub: DataFrame) -> DataFrame:
    """Each part of a definition needs the part before it."""
    w = Window.partitionBy(*SIDE, "node_key").orderBy("seq")
    return sub.select(*SIDE, F.col("sub_id").alias("src"), F.lag("sub_id").over(w).alias("dst")).filter("dst is not null")


def dependency_edges(sub: DataFrame, deps: DataFrame) -> DataFrame:
    """The first part of a user needs the last part of what it depends on; both must have parts."""
    ends = sub.groupBy(*SIDE, "node_key").agg(F.min_by("sub_id", "seq").alias("first"), F.max_by("sub_id", "seq").alias("last"))
    d = deps.select(*SIDE, "src_key", "dst_key").distinct()
    d = d.join(ends.select(*SIDE, F.col("node_key").alias("src_key"), F.col("first").alias("src")), [*SIDE, "src_key"])
    d = d.join(ends.select(*SIDE, F.col("node_key").alias("dst_key"), F.col("last").alias("dst")), [*SIDE, "dst_key"])
    return d.select(*SIDE, "src", "dst").distinct()


def hunk_edges(sub: DataFrame, deps: DataFrame) -> DataFrame:
    return chain_edges(sub).unionByName(dependency_edges(sub, deps)).distinct()


def matches(sub: DataFrame) -> DataFrame:
    """(pair_id, a, b): parts of both sides with equal description and hunk; of several, the first by start and key."""
    first = sub.groupBy("pair_id", "variant", "desc_key", "dcb_id").agg(F.min(F.struct("start", "node_key", "sub_id")).alias("f"))
    side = lambda v, c: first.filter(F.col("variant") == v).select("pair_id", "desc_key", "dcb_id", F.col("f.sub_id").alias(c))
    return side("A", "a").join(side("B", "b"), ["pair_id", "desc_key", "dcb_id"]).select("pair_id", "a", "b")


def unmatched(sub: DataFrame, matched: DataFrame) -> DataFrame:
    """Parts without a partner."""
    ids = matched.select("pair_id", F.col("a").alias("sub_id")).unionByName(matched.select("pair_id", F.col("b").alias("sub_id")))
    return sub.join(ids, ["pair_id", "sub_id"], "left_anti")


def units(sub: DataFrame, matched: DataFrame) -> DataFrame:
    """(pair_id, unit, a, b, dcb_id, diff_type): a row for each matched pair and for each part without a partner."""
    rest = unmatched(sub, matched)
    a = F.when(F.col("variant") == "A", F.col("sub_id"))
    b = F.when(F.col("variant") == "B", F.col("sub_id"))
    single = rest.select("pair_id", F.col("sub_id").alias("unit"), a.alias("a"), b.alias("b"), "dcb_id", "diff_type")
    pair = matched.join(sub.select("pair_id", F.col("sub_id").alias("a"), "dcb_id", "diff_type"), ["pair_id", "a"])
    return single.unionByName(pair.select("pair_id", F.col("a").alias("unit"), "a", "b", "dcb_id", "diff_type"))


def members(unit_rows: DataFrame) -> DataFrame:
    """(pair_id, sub_id, unit, diff_type, alone): the parts of all units."""
    one = lambda c: unit_rows.filter(F.col(c).isNotNull()).select("pair_id", F.col(c).alias("sub_id"), "unit", "diff_type", (F.col("a").isNull() | F.col("b").isNull()).alias("alone"))
    return one("a").unionByName(one("b"))
