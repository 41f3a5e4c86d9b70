"""Hunk files that arrive over time give the rows of one run over all of them."""

from hunkwise.sources import text
from hunkwise.streaming import incremental


def test_files_in_two_batches(spark, tmp_path):
    src, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    (tmp_path / "in").mkdir()
    body = "@ a.c, 9, 9\n+ 1, 2, = ,1, 0\n# 5, 1, = ,4, 2\n"
    for k in (1, 2):
        (tmp_path / "in" / f"h{k}").write_text(body * k)
        incremental.follow(spark, src, out, marks, once=True).awaitTermination()
    got = spark.read.parquet(out)
    want = text.parse_hunks(text.read_lines(spark, src))
    assert got.select("batch").distinct().count() == 2
    rows = lambda df: sorted(map(tuple, df.drop("batch").collect()))
    assert rows(got) == rows(want) and len(rows(got)) == 6
    incremental.follow(spark, src, out, marks, once=True).awaitTermination()
    assert rows(spark.read.parquet(out)) == rows(want)
