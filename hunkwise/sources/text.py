"""Readers of the text formats: hunk files, range files, diffs, merge lists, ground truth.

A parser takes lines (path, line_no, line) and returns rows; ``read_lines`` makes such lines from
files of any file system that Spark reads.  Line numbers start at 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# The formats of the files' lines, and the line count that marks a file taken from side A.
HEADER = r"^@ (.*?), (-?\d+), (-?\d+)\s*$"
HUNK = r"^([+\-#]) (\d+), (\d+), = ,(\d+), (\d+)\s*$"
RANGE = r"^([a-z]), (\d+), (\d+), (.*)$"
DIFF = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
TRUTH = r"^\s*([+\-#] )?(\d+),+ *(\d+),? = ,?(\d+), (\d+),?\s*$"
PAIR = r"([0-9a-f]{6,40})_([0-9a-f]{6,40})"
TAKEN_FROM_A = -2


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of every file below ``path``.  A file is one row until it is split: meant for many small files."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return files.select("path", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("line_no", "line"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name) of every file below ``path``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return found.withColumn("name", F.element_at(F.split("path", "/"), -1))


def pair_of(path: Column) -> Column:
    """The ``<a>_<b>`` folder that a path lies in, else null."""
    found = F.regexp_extract(path, rf"(?:^|/){PAIR}(?:/|$)", 0)
    return F.when(found != "", F.translate(found, "/", ""))


def commits_of(pair: Column) -> tuple[Column, Column]:
    return F.substring_index(pair, "_", 1), F.substring_index(pair, "_", -1)


def carried(lines: DataFrame, header: Column, name: str, keys=("path",), order=("line_no",)) -> DataFrame:
    """Adds ``name``: the last value of ``header`` that is not null, up to each line of its file."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(header, ignorenulls=True).over(w))


def _int(pattern: str, k: int, line: str = "line") -> Column:
    return F.expr(f"try_cast(nullif(regexp_extract({line}, r'{pattern}', {k}), '') as int)")


def parse_headers(lines: DataFrame) -> DataFrame:
    """(path, header_seq, file, lines_a, lines_b, fast_merged): the files of hunk files.

    fast_merged is A for line counts of -2 on side A, B for other pairs of negative counts, else null.
    """
    h = lines.filter(F.col("line").startswith("@ "))
    a, b = _int(HEADER, 2), _int(HEADER, 3)
    out = h.select("path", F.col("line_no").alias("header_seq"), F.regexp_extract("line", HEADER, 1).alias("file"), a.alias("lines_a"), b.alias("lines_b"))
    fast = F.when((F.col("lines_a") < 0) & (F.col("lines_b") < 0), F.when(F.col("lines_a") == TAKEN_FROM_A, "A").otherwise("B"))
    return out.withColumn("fast_merged", fast)


def parse_hunks(lines: DataFrame) -> DataFrame:
    """(path, hunk_seq, header_seq, file, diff_type, start_a, len_a, start_b, len_b): hunks under their last header.

    Lines that are neither header nor hunk, and hunks before any header, are dropped.
    """
    is_header = F.col("line").startswith("@ ")
    seq = carried(lines, F.when(is_header, F.struct(F.col("line_no").alias("seq"), F.regexp_extract("line", HEADER, 1).alias("file"))), "h")
    hunks = seq.filter(~is_header & F.col("line").rlike(HUNK) & F.col("h").isNotNull())
    numbers = [_int(HUNK, k).alias(n) for k, n in enumerate(("start_a", "len_a", "start_b", "len_b"), 2)]
    return hunks.select("path", F.col("line_no").alias("hunk_seq"), F.col("h.seq").alias("header_seq"), F.col("h.file").alias("file"), F.substring("line", 1, 1).alias("diff_type"), *numbers)


def distinct_files(headers: DataFrame) -> DataFrame:
    """Files once a pair: a header that repeats a file of its hunk file is dropped, the first stays."""
    w = Window.partitionBy("path", "file").orderBy("header_seq")
    return headers.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def real_files(headers: DataFrame) -> DataFrame:
    """Files whose line counts are known; the others are fast-merged and have no hunks yet."""
    return headers.filter("lines_a >= 0 and lines_b >= 0")


def before_decrease(rows: DataFrame, keys, order, value: str) -> DataFrame:
    """The rows of each key before the first one whose value is lower than the one before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_fell", (F.col(value) < F.lag(value).over(w)).cast("int"))
    gone = F.coalesce(F.max("_fell").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return marked.withColumn("_gone", gone).filter("_gone = 0").drop("_fell", "_gone")


def parse_ranges(lines: DataFrame) -> DataFrame:
    """(path, range_seq, rtype, start, end, name): definition ranges, up to the first decrease of start.

    Codes f, e or c, g and t are func, composite, gvar and alias; b keeps the type of the line before.
    """
    rows = lines.filter(F.col("line").rlike(RANGE))
    rows = rows.select("path", F.col("line_no").alias("range_seq"), F.regexp_extract("line", RANGE, 1).alias("code"), _int(RANGE, 2).alias("start"), _int(RANGE, 3).alias("end"), F.regexp_extract("line", RANGE, 4).alias("name"))
    rows = before_decrease(rows, ["path"], ["range_seq"], "start")
    kind = F.when(F.col("code") == "f", "func").when(F.col("code").isin("e", "c"), "composite").when(F.col("code") == "g", "gvar").when(F.col("code") == "t", "alias")
    return carried(rows, kind, "rtype", order=("range_seq",)).select("path", "range_seq", "rtype", "start", "end", "name")


def parse_diff(lines: DataFrame, compat: bool = False) -> DataFrame:
    """(path, line_no, start_a, len_a, start_b, len_b) of unified-diff headers; minus is side B, plus side A.

    An omitted length is 1.  With ``compat`` it is 0 when just one length is omitted and the other is
    not 0.  Hunks that begin at 0 with length 0 on a side (a file made or deleted) are dropped.
    """
    rows = lines.filter(F.col("line").rlike(DIFF))
    sb, lb, sa, la = (_int(DIFF, k) for k in (1, 2, 3, 4))
    rows = rows.select("path", "line_no", sa.alias("start_a"), la.alias("la"), sb.alias("start_b"), lb.alias("lb"))
    if compat:
        one = lambda own, other: F.when(F.col(own).isNull() & F.col(other).isNotNull() & (F.col(other) != 0), 0).otherwise(F.coalesce(own, F.lit(1)))
        rows = rows.withColumns({"len_a": one("la", "lb"), "len_b": one("lb", "la")})
    else:
        rows = rows.withColumns({"len_a": F.coalesce("la", F.lit(1)), "len_b": F.coalesce("lb", F.lit(1))})
    rows = rows.filter(~((F.col("start_a") == 0) & (F.col("len_a") == 0)) & ~((F.col("start_b") == 0) & (F.col("len_b") == 0)))
    return rows.select("path", "line_no", "start_a", "len_a", "start_b", "len_b")


def parse_direct_merges(lines: DataFrame) -> DataFrame:
    """(file, side) of lines ``<path> --- A|B``; the last line of a file counts."""
    rows = lines.filter(F.col("line").contains(" --- ")).select("path", "line_no", F.substring_index("line", " --- ", 1).alias("file"), F.trim(F.element_at(F.split("line", " --- "), 2)).alias("side"))
    return rows.groupBy("file").agg(F.max_by("side", F.struct("path", "line_no")).alias("side"))


def parse_line_counts(lines: DataFrame) -> DataFrame:
    """(line_no, file, lines_a, lines_b) of lines ``<path>, <a>, <b>``."""
    pattern = r"^(.*), (\d+), (\d+)\s*$"
    return lines.filter(F.col("line").rlike(pattern)).select("line_no", F.regexp_extract("line", pattern, 1).alias("file"), _int(pattern, 2).alias("lines_a"), _int(pattern, 3).alias("lines_b"))


def parse_commit_pairs(lines: DataFrame) -> DataFrame:
    """(path, line_no, project, commit_a, commit_b); ``Name:`` lines name the project, lines under 3 characters are skipped."""
    title = F.regexp_extract("line", r"^(.*):\s*$", 1)
    rows = carried(lines, F.when(title != "", title), "project").filter((F.length("line") >= 3) & F.col("line").contains(" ") & (title == ""))
    parts = F.split(F.rtrim("line"), " ")
    return rows.select("path", "line_no", "project", parts[0].alias("commit_a"), parts[1].alias("commit_b"))


def parse_merges(lines: DataFrame) -> DataFrame:
    """(commit, parents) of lines ``<commit> <parent> <parent>...`` with two parents at least."""
    parts = F.split(F.trim("line"), r"\s+")
    return lines.select(parts[0].alias("commit"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("parents")).filter(F.size("parents") >= 2)


def parse_truth(lines: DataFrame) -> DataFrame:
    """(path, line_no, file, diff_type, start_a, len_a, start_b, len_b) of hand-made block lists, in all their notations."""
    block = F.col("line").rlike(TRUTH)
    name = F.trim(F.regexp_replace(F.regexp_replace("line", "^@ ", ""), r", -?\d+, -?\d+\s*$", ""))
    rows = carried(lines, F.when(~block & (F.trim("line") != ""), name), "file").filter(block)
    kind = F.expr(f"nullif(trim(regexp_extract(line, r'{TRUTH}', 1)), '')")
    numbers = [_int(TRUTH, k).alias(n) for k, n in enumerate(("start_a", "len_a", "start_b", "len_b"), 2)]
    return rows.select("path", "line_no", "file", kind.alias("diff_type"), *numbers)


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """(a, b): a CSV of two integer columns under a heading."""
    return spark.read.csv(path, header=True, schema="A int, B int").toDF("a", "b")


def unmerged(lines: DataFrame) -> DataFrame:
    """(file) of status lines that begin with UU."""
    return lines.filter(F.col("line").startswith("UU")).select(F.trim(F.substring("line", 4, 1 << 20)).alias("file"))
