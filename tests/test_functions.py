"""Paths, names, prototypes and the paired test."""

import random

from pyspark.sql import functions as F

from hunkwise.functions import names, paths, stats


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_paths(spark):
    for raw, want in (("a/./b/../c", "/a/c"), ("/a/b/c/.../d", "/a/d"), ("", "/"), ("/../x", "/x"), ("//a///b/", "/a/b"), (".../x", "/x")):
        assert one(spark, paths.normalised(F.col("p")), p=raw) == want
    assert one(spark, paths.encoded(F.col("p")), p="/src/a.b.c") == "@src@a$b$c"
    at = paths.base_path(F.col("p"), F.col("d"), "/w/proj/")
    assert one(spark, at, p="x/../y.c", d="/w/proj/src") == "src/y.c"
    assert one(spark, at, p="/w/project/y.c", d="") is None
    assert one(spark, paths.has_suffix(F.col("p")), p="a.c++") and not one(spark, paths.has_suffix(F.col("p")), p="a.cs")


def test_project_files(spark):
    rows = spark.createDataFrame([("a.c", "/r/s"), ("b.c", "/r/s"), ("a.c", "/x")], "path string, folder string")
    files = spark.createDataFrame([("s/a.c",), ("s/z.c",)], "file string")
    assert [r.file for r in paths.in_project(rows, files, "/r").collect()] == ["s/a.c"]


def test_names(spark):
    assert one(spark, names.link_name(F.col("a"), F.col("b")), a="", b="n") == "n"
    assert one(spark, names.shown_name(F.col("a")), a="") == "*"
    rel = names.relation(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    assert [one(spark, rel, a=a, b=b, c=5, d=9) for a, b in ((5, 9), (6, 7), (1, 4), (10, 12), (4, 6))] == ["INCLUDE", "INCLUDE", "NOT_INCLUDE", "NOT_INCLUDE", "PARTLY_INCLUDE"]
    key = names.desc_key(F.col("k"), F.col("f"), F.col("n"), F.col("p"))
    assert one(spark, key, k="func", f="a.c", n="g", p="g{}=0") == "func|a.c|g{}=0" and one(spark, key, k="type", f="a.c", n="g", p="x") == "type|a.c|g"
    state = names.debug_state(F.col("f"), F.col("i"), F.col("l"))
    assert [one(spark, state, f=f, i=i, l=n) for f, i, n in ((False, True, 3), (True, False, 3), (True, True, 3), (True, True, 0))] == [0, -1, 1, 0]
    used = names.user_defined(F.col("k"), F.lit("f"), F.lit("n"), F.lit(3), F.lit(True))
    assert one(spark, used, k="derived") and not one(spark, used, k="basic")


def test_prototypes(spark):
    types = spark.createDataFrame(
        [(1, "basic", None, None, "int", None), (2, "derived", "pointer", None, None, 1), (3, "derived", "const", None, "", 2), (4, "composite", "other", "_ZTS1X", "X", None), (5, "composite", "array", None, None, 4),
         (6, "derived", "pointer", None, None, None), (7, "subroutine", None, None, None, None), (8, "derived", "pointer", None, None, 7), (9, "subroutine", None, None, None, None), (10, "derived", "typedef", None, "size_t", 1),
         (11, "derived", "pointer", None, None, 12), (12, "derived", "pointer", None, None, 11), (13, "subroutine", None, None, None, None)],
        "type_id long, kind string, tag string, identifier string, name string, base_id long",
    )
    members = spark.createDataFrame([(7, 0, 3), (7, 1, 5), (7, 2, 6), (9, 0, None), (9, 1, 8), (9, 2, 10), (13, 0, 11)], "type_id long, seq int, member_id long")
    got = {r.type_id: r.rep for r in names.prototypes(types, members).collect()}
    assert got == {
        1: "[int]", 2: "[*[int]]", 3: "[const[*[int]]]", 4: "[_ZTS1X]", 5: "[...[_ZTS1X]]", 6: "[*[void]]", 7: "{[const[*[int]]][...[_ZTS1X]][*[void]]}=3", 8: "[*{[const[*[int]]][...[_ZTS1X]][*[void]]}=3]",
        9: "{[*{[const[*[int]]][...[_ZTS1X]][*[void]]}=3][size_t]}=2", 10: "[size_t]",
    }
    fs = spark.createDataFrame([("f", 7)], "name string, type_id long")
    assert names.function_prototypes(fs, names.prototypes(types, members)).first().prototype_rep.startswith("f{[const")


def test_paired_test(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 60), r.randint(0, 70)) for _ in range(50)] + [(None, 3)]
    got = stats.paired_test(spark.createDataFrame(rows, "a int, b int"), F.col("a"), F.col("b")).first()
    d = [a - b for a, b in rows if a is not None]
    mean = sum(d) / len(d)
    sd = (sum((x - mean) ** 2 for x in d) / (len(d) - 1)) ** 0.5
    assert abs(got.t - mean / (sd / len(d) ** 0.5)) < 1e-9 and 0 < got.p < 1
    # Known values of the t distribution.
    assert abs(stats.p_less(-1.812461, 10) - 0.05) < 1e-6 and abs(stats.p_less(2.228139, 10) - 0.975) < 1e-6 and abs(stats.p_less(0, 5) - 0.5) < 1e-12
