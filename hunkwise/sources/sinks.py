"""Writers of the text formats, as ordered lines and as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The lines of hunk files.
HEADER_LINE = "@ %s, %d, %d"
HUNK_LINE = "%s %d, %d, = ,%d, %d"


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """One text file of the column ``line`` in order; meant for reports, whose size people can read."""
    lines.orderBy(*order).coalesce(1).select("line").write.mode("overwrite").text(path)


def hunk_lines(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """(path, header_seq, hunk_seq, line): the lines of hunk files, a header and then its hunks.

    files: path, header_seq, file, lines_a, lines_b.  hunks: path, header_seq, hunk_seq and the hunk.
    """
    head = files.select("path", "header_seq", F.lit(-1).alias("hunk_seq"), F.format_string(HEADER_LINE, "file", "lines_a", "lines_b").alias("line"))
    body = hunks.select("path", "header_seq", "hunk_seq", F.format_string(HUNK_LINE, "diff_type", "start_a", "len_a", "start_b", "len_b").alias("line"))
    return head.unionByName(body)


def with_diffs(files: DataFrame, hunks: DataFrame, diffs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and hunks in which fast-merged files have the hunks of their diff.

    diffs: path, file, line_no, start_a, len_a, start_b, len_b.  Real files come first, then the
    fast-merged ones, whose line counts become those of ``diffs`` lines_a and lines_b where present,
    else 0.
    """
    fast = files.filter(F.col("fast_merged").isNotNull())
    real = files.filter(F.col("fast_merged").isNull())
    top = 1 << 30  # behind every real header
    counts = ("lines_a", "lines_b") if {"lines_a", "lines_b"} <= set(diffs.columns) else ()
    known = diffs.select("path", "file", *counts).distinct() if counts else None
    moved = fast.withColumn("header_seq", F.col("header_seq") + top).drop("lines_a", "lines_b")
    moved = moved.join(known, ["path", "file"], "left") if counts else moved.withColumns({"lines_a": F.lit(None).cast("int"), "lines_b": F.lit(None).cast("int")})
    moved = moved.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("lines_a", "lines_b")})
    new = moved.select("path", "file", "header_seq", "fast_merged").join(diffs.drop("lines_a", "lines_b"), ["path", "file"])
    new = new.withColumn("diff_type", F.when(F.col("fast_merged") == "A", "+").otherwise("-")).withColumnRenamed("line_no", "hunk_seq")
    return real.unionByName(moved.select(*real.columns)), hunks.unionByName(new.select(*hunks.columns))


def whole_file_hunks(merges: DataFrame, counts: DataFrame) -> DataFrame:
    """(line_no, file, lines_a, lines_b, diff_type, start_a, len_a, start_b, len_b): a hunk over each directly merged file."""
    kind = F.when(F.col("side") == "A", "+").otherwise("-")
    one = F.lit(1)
    return counts.join(merges, "file").select("line_no", "file", "lines_a", "lines_b", kind.alias("diff_type"), one.alias("start_a"), F.col("lines_a").alias("len_a"), one.alias("start_b"), F.col("lines_b").alias("len_b"))


def prepended(whole: DataFrame, lines: DataFrame) -> DataFrame:
    """(part, line_no, k, line): whole-file hunks and their headers, then the lines that were there."""
    head = whole.select(F.lit(0).alias("part"), "line_no", F.lit(0).alias("k"), F.format_string(HEADER_LINE, "file", "lines_a", "lines_b").alias("line"))
    body = whole.select(F.lit(0).alias("part"), "line_no", F.lit(1).alias("k"), F.format_string(HUNK_LINE, "diff_type", "start_a", "len_a", "start_b", "len_b").alias("line"))
    return head.unionByName(body).unionByName(lines.select(F.lit(1).alias("part"), "line_no", F.lit(0).alias("k"), "line"))


def conflict_tuples(tuples: DataFrame) -> DataFrame:
    """(line) ``resolved a b``; a merge of more parents gives a line for the first with each other one."""
    return tuples.select(F.concat_ws(" ", "resolved", "commit_a", "commit_b").alias("line"))


def merge_tuples(merges: DataFrame) -> DataFrame:
    """(resolved, commit_a, commit_b) of (commit, parents): the first parent with each other parent."""
    rest = F.slice("parents", 2, F.size("parents") - 1)
    return merges.select(F.col("commit").alias("resolved"), F.col("parents")[0].alias("commit_a"), F.explode(rest).alias("commit_b"))
