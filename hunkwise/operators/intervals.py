"""Interval joins over line numbers: first covering range, last painter, overlap.

Rows of both sides meet on their file and a bucket of lines, so a join compares intervals near each
other only, however many a file has.  An interval stands in every bucket that it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

FILE = ["pair_id", "variant", "file"]
LINES = 128


def _buckets(start: Column, end: Column, lines: int) -> Column:
    return F.explode(F.sequence(F.floor(start / lines), F.floor(end / lines)))


def covering(points: DataFrame, at: str, ranges: DataFrame, start: str, end: str, keys: list[str], lines: int = LINES) -> DataFrame:
    """Points joined to the ranges with start <= at <= end; other columns must differ."""
    p = points.withColumn("_bucket", F.floor(F.col(at) / lines))
    r = ranges.filter(F.col(start) <= F.col(end)).withColumn("_bucket", _buckets(F.col(start), F.col(end), lines))
    return p.join(r, [*keys, "_bucket"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("_bucket")


def overlapping(a: DataFrame, a_start: str, a_end: str, b: DataFrame, b_start: str, b_end: str, keys: list[str], lines: int = LINES) -> DataFrame:
    """Rows of a and b that share a line; a pair stands once."""
    x = a.filter(F.col(a_start) <= F.col(a_end)).withColumn("_bucket", _buckets(F.col(a_start), F.col(a_end), lines))
    y = b.filter(F.col(b_start) <= F.col(b_end)).withColumn("_bucket", _buckets(F.col(b_start), F.col(b_end), lines))
    both = x.join(y, [*keys, "_bucket"]).filter((F.col(a_start) <= F.col(b_end)) & (F.col(b_start) <= F.col(a_end)))
    # The first shared line lies in one bucket only.
    return both.filter(F.floor(F.greatest(a_start, b_start) / lines) == F.col("_bucket")).drop("_bucket")


def tag_nodes(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Nodes with the start and end of the first range of their file that covers their line, names them and is of their kind.

    nodes: FILE, node_key, kind, name, debug_line.  ranges: FILE, range_seq, rtype, start, end, name.
    Either name may contain the other.  Nodes without such a range are dropped.  paint_seq orders the
    rest of a file by line, length of name, name and key.
    """
    kind = F.when(F.col("rtype").isin("composite", "alias"), "type").otherwise(F.col("rtype"))
    r = ranges.select(*FILE, "range_seq", kind.alias("kind"), "start", "end", F.col("name").alias("_range_name"))
    met = covering(nodes, "debug_line", r, "start", "end", [*FILE, "kind"])
    met = met.filter((F.expr("instr(name, _range_name)") > 0) | (F.expr("instr(_range_name, name)") > 0))
    own = [*FILE, "node_key", "kind", "name", "debug_line"]
    best = met.groupBy(*own).agg(F.min(F.struct("range_seq", "start", "end")).alias("r"))
    return painted(best.select(*own, "r.start", "r.end"))


def painted(nodes: DataFrame) -> DataFrame:
    """Adds the order in which the nodes of a file are painted."""
    w = Window.partitionBy(*FILE).orderBy("debug_line", F.length("name"), "name", "node_key")
    return nodes.withColumn("paint_seq", F.row_number().over(w).cast("long"))


def visible_segments(painted: DataFrame) -> DataFrame:
    """(FILE, node_key, start, end): the stretches of lines on which each node was the last to paint.

    painted: FILE, node_key, start, end, paint_seq.  Stretches are cut at every bound of a range, so a
    node may have neighbouring ones.
    """
    p = painted.filter("start <= end")
    bounds = p.select(*FILE, F.col("start").alias("s")).unionByName(p.select(*FILE, (F.col("end") + 1).alias("s"))).distinct()
    w = Window.partitionBy(*FILE).orderBy("s")
    parts = bounds.withColumn("e", F.lead("s").over(w) - 1).filter("e is not null")
    top = covering(parts, "s", p.select(*FILE, "start", "end", "paint_seq", "node_key"), "start", "end", FILE)
    top = top.groupBy(*FILE, "s", "e").agg(F.max_by("node_key", F.struct("paint_seq", "node_key")).alias("node_key"))
    return top.select(*FILE, "node_key", F.col("s").alias("start"), F.col("e").alias("end"))


def hunk_sides(hunks: DataFrame) -> DataFrame:
    """(FILE, dcb_id, diff_type, h_start, h_len, h_end): a row for each side of each hunk."""
    side = lambda v: hunks.select("pair_id", F.lit(v.upper()).alias("variant"), "file", "dcb_id", "diff_type", F.col(f"start_{v}").alias("h_start"), F.col(f"len_{v}").alias("h_len"))
    return side("a").unionByName(side("b")).withColumn("h_end", F.col("h_start") + F.col("h_len") - 1)


def map_hunks(painted: DataFrame, hunks: DataFrame) -> DataFrame:
    """(FILE, node_key, dcb_id): nodes visible on a line at least of each hunk's side; empty sides map to none."""
    seen = visible_segments(painted)
    sides = hunk_sides(hunks).filter("h_len > 0")
    both = overlapping(seen, "start", "end", sides.select(*FILE, "dcb_id", "h_start", "h_end"), "h_start", "h_end", FILE)
    return both.select(*FILE, "node_key", "dcb_id").distinct()
