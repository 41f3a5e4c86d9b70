"""Parsers and writers of the text formats."""

import pytest
from pyspark.sql import functions as F

from hunkwise.functions import names
from hunkwise.operators import facts
from hunkwise.sources import ir, sinks, text

HUNKS = """@ src/a.c, 100, 90
+ 3, 2, = ,3, 0
# 10, 5, = ,8, 5
@ lib/b.h, -2, -1
@ lib/c.h, -1, -2
@ lib/b.h, -2, -1
noise
- 7, 0, = ,9, 4
"""


@pytest.fixture
def lines(spark):
    def make(body, path="f"):
        return spark.createDataFrame([(path, k, x) for k, x in enumerate(body.splitlines())], "path string, line_no int, line string")

    return make


def test_files_on_disk(spark, tmp_path):
    for pair in ("0a1b2c3d_4e5f6a7b", "1111111_2222222"):
        (tmp_path / pair).mkdir()
        (tmp_path / pair / "hunks").write_text(HUNKS)
    rows = text.read_lines(spark, str(tmp_path)).withColumn("pair_id", text.pair_of(text.F.col("path")))
    assert rows.count() == 16 and {r.pair_id for r in rows.collect()} == {"0a1b2c3d_4e5f6a7b", "1111111_2222222"}
    a, b = text.commits_of(text.F.col("pair_id"))
    assert {tuple(r) for r in rows.select(a, b).distinct().collect()} == {("0a1b2c3d", "4e5f6a7b"), ("1111111", "2222222")}
    assert {r["name"] for r in text.list_files(spark, str(tmp_path)).collect()} == {"hunks"}


def test_headers_and_hunks(lines):
    heads = text.parse_headers(lines(HUNKS))
    assert [tuple(r)[2:] for r in heads.orderBy("header_seq").collect()] == [("src/a.c", 100, 90, None), ("lib/b.h", -2, -1, "A"), ("lib/c.h", -1, -2, "B"), ("lib/b.h", -2, -1, "A")]
    assert [r.header_seq for r in text.distinct_files(heads).orderBy("header_seq").collect()] == [0, 3, 4]
    assert text.real_files(heads).count() == 1
    hunks = text.parse_hunks(lines(HUNKS)).orderBy("hunk_seq").collect()
    assert [tuple(r)[2:] for r in hunks] == [(0, "src/a.c", "+", 3, 2, 3, 0), (0, "src/a.c", "#", 10, 5, 8, 5), (5, "lib/b.h", "-", 7, 0, 9, 4)]


def test_round_trip(lines):
    heads, hunks = text.parse_headers(lines(HUNKS)), text.parse_hunks(lines(HUNKS))
    out = sinks.hunk_lines(heads, hunks).orderBy("header_seq", "hunk_seq").collect()
    assert [r.line for r in out] == [x for x in HUNKS.splitlines() if x != "noise"]


def test_ranges_stop_where_start_falls(lines):
    body = "f, 1, 4, a\ne, 5, 9, b\nb, 5, 6, c\nt, 9, 9, d, e\ng, 2, 3, x\nf, 12, 13, y"
    got = [tuple(r)[1:] for r in text.parse_ranges(lines(body)).orderBy("range_seq").collect()]
    assert got == [(0, "func", 1, 4, "a"), (1, "composite", 5, 9, "b"), (2, "composite", 5, 6, "c"), (3, "alias", 9, 9, "d, e")]


def test_diff_headers(lines):
    body = "@@ -10 +12 @@\n@@ -10,0 +11 @@ f()\n@@ -0,0 +1,5 @@\n@@ -10 +12,3 @@\n@@ -5,2 +0,0 @@\n+x"
    assert [tuple(r)[1:] for r in text.parse_diff(lines(body)).orderBy("line_no").collect()] == [(0, 12, 1, 10, 1), (1, 11, 1, 10, 0), (3, 12, 3, 10, 1)]
    assert [tuple(r)[1:] for r in text.parse_diff(lines(body), compat=True).orderBy("line_no").collect()] == [(0, 12, 1, 10, 1), (1, 11, 1, 10, 0), (3, 12, 3, 10, 0)]


def test_whole_file_hunks(lines):
    merges = text.parse_direct_merges(lines("x.c --- A\ny.c --- B\n"))
    counts = text.parse_line_counts(lines("x.c, 7, 9\nz.c, 1, 1\ny.c, 3, 4"))
    out = sinks.prepended(sinks.whole_file_hunks(merges, counts), lines("@ a.c, 1, 2\n+ 1, 1, = ,1, 2"))
    assert [r.line for r in out.orderBy("part", "line_no", "k").collect()] == ["@ x.c, 7, 9", "+ 1, 7, = ,1, 9", "@ y.c, 3, 4", "- 1, 3, = ,1, 4", "@ a.c, 1, 2", "+ 1, 1, = ,1, 2"]


def test_fast_merged_files_get_their_diff(lines, spark):
    heads, hunks = text.distinct_files(text.parse_headers(lines(HUNKS))), text.parse_hunks(lines(HUNKS)).filter("file = 'src/a.c'")
    diffs = spark.createDataFrame([("f", "lib/b.h", 0, 5, 1, 6, 2, 40, 50), ("f", "lib/c.h", 1, 7, 1, 8, 3, 20, 30)], "path string, file string, line_no int, start_a int, len_a int, start_b int, len_b int, lines_a int, lines_b int")
    files, all_hunks = sinks.with_diffs(heads, hunks, diffs)
    out = sinks.hunk_lines(files, all_hunks).orderBy("header_seq", "hunk_seq").collect()
    assert [r.line for r in out] == ["@ src/a.c, 100, 90", "+ 3, 2, = ,3, 0", "# 10, 5, = ,8, 5", "@ lib/b.h, 40, 50", "+ 5, 1, = ,6, 2", "@ lib/c.h, 20, 30", "- 7, 1, = ,8, 3"]


def test_commit_lists(lines):
    pairs = text.parse_commit_pairs(lines("One:\naaaaaaa bbbbbbb\n\nTwo Words:\nccccccc ddddddd \n"))
    assert [tuple(r)[2:] for r in pairs.orderBy("line_no").collect()] == [("One", "aaaaaaa", "bbbbbbb"), ("Two Words", "ccccccc", "ddddddd")]
    merges = text.parse_merges(lines("m1 a b\nm2 a\nm3 a b c"))
    assert sorted(r.line for r in sinks.conflict_tuples(sinks.merge_tuples(merges)).collect()) == ["m1 a b", "m3 a b", "m3 a c"]


def test_truth_in_all_notations(lines):
    body = "src/a.c\n    1, 2, = 3, 4\n@ src/b.c, 10, 20\n# 5, 6, = ,7, 8\n+ 5,, 6 = 7, 8, \nsrc/c.c\n   9, 1 = ,2, 3"
    got = [tuple(r)[2:] for r in text.parse_truth(lines(body)).orderBy("line_no").collect()]
    assert got == [("src/a.c", None, 1, 2, 3, 4), ("src/b.c", "#", 5, 6, 7, 8), ("src/b.c", "+", 5, 6, 7, 8), ("src/c.c", None, 9, 1, 2, 3)]


def test_timings_and_status(spark, lines, tmp_path):
    (tmp_path / "t.csv").write_text("A,B\n5,10\n18,31\n")
    assert [tuple(r) for r in text.read_timings(spark, str(tmp_path / "t.csv")).collect()] == [(5, 10), (18, 31)]
    assert [r.file for r in text.unmerged(lines("UU src/a b.c\n M x\nUU y.c")).collect()] == ["src/a b.c", "y.c"]


def test_written_report(spark, lines, tmp_path):
    sinks.write_lines(lines("b\na\nc"), ["line"], str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == "a\nb\nc\n"


MODULE = r"""
; ModuleID = 'a.c'
source_filename = "a.c"
%struct.node = type { i32, ptr }

@count = dso_local global i32 0, align 4, !dbg !0
@hidden = internal constant i32 7, !dbg !5
@other = external global i32, align 4
@.str = private unnamed_addr constant [4 x i8] c"a@b\00", align 1

define dso_local i32 @main(i32 noundef %n) #0 !dbg !20 {
entry:
  %x = call i32 @helper(ptr noundef @count), !dbg !30
  call void @llvm.dbg.declare(metadata ptr %x, metadata !31, metadata !DIExpression()), !dbg !32
  %y = load i32, ptr @other, align 4
  %f = load ptr, ptr %p
  %z = call i32 %f(i32 %y)
  %w = invoke i32 @"quoted name"(i32 1) to label %a unwind label %b
  ret i32 %x
}

define internal i32 @helper(ptr %p) !dbg !22 {
  ret i32 0
}

declare i32 @"quoted name"(i32)

!0 = !DIGlobalVariableExpression(var: !1, expr: !DIExpression())
!1 = distinct !DIGlobalVariable(name: "count", scope: !2, file: !3, line: 4, type: !4, isLocal: false, isDefinition: true)
!2 = distinct !DICompileUnit(language: DW_LANG_C99, file: !3, producer: "clang, \"x\"")
!3 = !DIFile(filename: "./src/../a.c", directory: "/r", checksumkind: CSK_MD5, checksum: "00")
!4 = !DIBasicType(name: "int", size: 32, encoding: DW_ATE_signed)
!5 = !DIGlobalVariableExpression(var: !6, expr: !DIExpression())
!6 = distinct !DIGlobalVariable(name: "hidden", scope: !2, file: !3, line: 5, type: !8, isLocal: true, isDefinition: true)
!8 = !DIDerivedType(tag: DW_TAG_const_type, baseType: !4)
!9 = distinct !DICompositeType(tag: DW_TAG_structure_type, name: "node", file: !3, line: 8, size: 128, elements: !10)
!10 = !{!11, !12}
!11 = !DIDerivedType(tag: DW_TAG_member, name: "value", scope: !9, file: !3, line: 9, baseType: !4, size: 32)
!12 = !DIDerivedType(tag: DW_TAG_member, name: "next", scope: !9, file: !3, line: 10, baseType: !13, size: 64, offset: 64)
!13 = !DIDerivedType(tag: DW_TAG_pointer_type, baseType: !9, size: 64)
!14 = !DICompositeType(tag: DW_TAG_structure_type, name: "ahead", file: !3, line: 12, flags: DIFlagFwdDecl)
!20 = distinct !DISubprogram(name: "main", scope: !3, file: !3, line: 20, type: !21, scopeLine: 21, flags: DIFlagPrototyped, unit: !2)
!21 = !DISubroutineType(types: !23)
!22 = distinct !DISubprogram(name: "helper", linkageName: "_Z6helperPi", scope: !3, file: !3, line: 14, type: !24, unit: !2)
!23 = !{!4, !4}
!24 = !DISubroutineType(types: !25)
!25 = !{null, !13}
"""


def test_modules(spark):
    lines = spark.createDataFrame([("m1", k, x) for k, x in enumerate(MODULE.split("\n"))] + [("m2", 0, "no module"), ("m3", 0, "")], "path string, line_no int, line string")
    meta = ir.metadata(lines).cache()
    assert {r.fields["producer"] for r in meta.filter("what = 'DICompileUnit'").collect()} == {'clang, \\"x\\"'}
    symbols = ir.symbols(lines, meta).cache()
    got = {r.symbol: (r.sym_kind, r.linkage, r.is_defined, r["name"], r.file, r.debug_line) for r in symbols.collect()}
    assert got == {
        "count": ("gvar", "external", True, "count", "/r/a.c", 4), "hidden": ("gvar", "internal", True, "hidden", "/r/a.c", 5), "other": ("gvar", "external", False, None, None, 0), ".str": ("gvar", "internal", True, None, None, 0),
        "main": ("func", "external", True, "main", "/r/a.c", 20), "helper": ("func", "internal", True, "helper", "/r/a.c", 14), "quoted name": ("func", "external", False, None, None, 0),
    }
    assert {r.node_key for r in ir.definitions(symbols).collect()} == {"gvar|/r/a.c|4|count", "gvar|/r/a.c|5|hidden", "func|/r/a.c|20|main", "func|/r/a.c|14|_Z6helperPi"}
    uses = ir.uses(lines).cache()
    assert {(r.symbol, r.callee, r.used) for r in uses.collect()} == {("main", "helper", None), ("main", None, "count"), ("main", "llvm.dbg.declare", None), ("main", None, "other"), ("main", None, None), ("main", "quoted name", None)}
    calls = ir.calls(uses, symbols).withColumns({"pair_id": F.lit("p"), "variant": F.lit("A")})
    inside, by_name = facts.callee_links(calls)
    assert {(r.src_key, r.dst_key) for r in inside.collect()} == {("func|/r/a.c|20|main", "func|/r/a.c|14|_Z6helperPi")}
    assert {(r.src_key, r.ext_name) for r in by_name.collect()} == {("func|/r/a.c|20|main", "quoted name")}
    types = ir.types(meta).cache()
    assert {(r.type_id, r.kind, r.tag, r["name"], r.base_id, r.is_decl) for r in types.collect()} == {
        ("m1|4", "basic", "other", "int", None, False), ("m1|8", "derived", "const", None, "m1|4", False), ("m1|9", "composite", "other", "node", None, False), ("m1|11", "derived", "other", "value", "m1|4", False), ("m1|12", "derived", "other", "next", "m1|13", False),
        ("m1|13", "derived", "pointer", None, "m1|9", False), ("m1|14", "composite", "other", "ahead", None, True), ("m1|21", "subroutine", "other", None, None, False), ("m1|24", "subroutine", "other", None, None, False),
    }
    members = ir.type_members(meta, ir.lists(lines))
    assert {tuple(r)[1:] for r in members.collect()} == {("m1|9", 0, "m1|11"), ("m1|9", 1, "m1|12"), ("m1|21", 0, "m1|4"), ("m1|21", 1, "m1|4"), ("m1|24", 0, None), ("m1|24", 1, "m1|13")}
    reps = {r.type_id: r.rep for r in names.prototypes(types, members).collect()}
    assert reps["m1|24"] == "{[*[node]]}=1" and reps["m1|21"] == "{[int][int]}=2"
    resolved = facts.resolve_types(types.withColumn("inside", F.col("kind") != "basic"))
    assert {(r.type_id, r.base) for r in resolved.collect()} == {("m1|9", "m1|9"), ("m1|12", "m1|9"), ("m1|13", "m1|9"), ("m1|21", "m1|21"), ("m1|24", "m1|24")}
