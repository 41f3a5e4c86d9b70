"""The engine's operators against plain models on small and random inputs."""

import random

import pytest

from hunkwise.functions import names
from hunkwise.operators import components, cycles, facts, hunkgraph, intervals, report, violation
from hunkwise.plans import analysis, standin

NODE = "pair_id string, variant string, file string, node_key string, start int, end int, paint_seq long, desc_key string"
HUNK = "pair_id string, dcb_id long, file string, diff_type string, start_a int, len_a int, start_b int, len_b int"


def paint(spark, rows):
    return spark.createDataFrame([("p", *r) for r in rows], NODE)


def hunk_rows(spark, rows):
    return spark.createDataFrame([("p", *r) for r in rows], HUNK)


def test_later_paint_covers_earlier(spark):
    nodes = paint(spark, [("A", "f", "n1", 1, 10, 1, "k1"), ("A", "f", "n2", 5, 8, 2, "k2")])
    hunks = hunk_rows(spark, [(0, "f", "+", 3, 0, 1, 0), (1, "f", "+", 7, 1, 1, 0), (2, "f", "+", 9, 1, 1, 0), (3, "f", "+", 4, 3, 1, 0)])
    mapped = intervals.map_hunks(nodes, hunks)
    assert {(r.dcb_id, r.node_key) for r in mapped.collect()} == {(3, "n1"), (3, "n2"), (1, "n2"), (2, "n1")}
    sub = hunkgraph.sub_nodes(mapped, nodes, hunks)
    assert {(r.sub_id, r.start, r.end, r.seq) for r in sub.collect()} == {("A|n1|3", 4, 6, 1), ("A|n1|2", 9, 9, 2), ("A|n2|3", 5, 6, 1), ("A|n2|1", 7, 7, 2)}
    deps = spark.createDataFrame([("p", "A", "n1", "n2")], "pair_id string, variant string, src_key string, dst_key string")
    assert {(r.src, r.dst) for r in hunkgraph.chain_edges(sub).collect()} == {("A|n1|2", "A|n1|3"), ("A|n2|1", "A|n2|3")}
    assert {(r.src, r.dst) for r in hunkgraph.dependency_edges(sub, deps).collect()} == {("A|n1|3", "A|n2|1")}


def test_random_paint_against_an_array(spark):
    r = random.Random(3)
    nodes, hunks, want = [], [], set()
    for f in map(str, range(12)):
        lines = {}
        for k in range(r.randint(0, 25)):
            s = r.randint(1, 400)
            e = s + r.choice((0, 1, 5, 60, 300))
            nodes.append(("A", f, f"n{f}_{k}", s, e, k, "d"))
            lines.update((x, f"n{f}_{k}") for x in range(s, e + 1))
        for k in range(15):
            s, n = r.randint(1, 450), r.choice((0, 1, 4, 150))
            d = int(f) * 100 + k
            hunks.append((d, f, "+", s, n, 0, 0))
            want |= {(d, lines[x]) for x in range(s, s + n) if x in lines}
    got = intervals.map_hunks(paint(spark, nodes), hunk_rows(spark, hunks))
    assert {(x.dcb_id, x.node_key) for x in got.collect()} == want


def test_tagging(spark):
    ranges = spark.createDataFrame([("p", "A", "f", 1, "func", 10, 20, "foo"), ("p", "A", "f", 2, "func", 10, 30, ""), ("p", "A", "f", 3, "alias", 5, 6, "T")], "pair_id string, variant string, file string, range_seq int, rtype string, start int, end int, name string")
    nodes = spark.createDataFrame(
        [("p", "A", "f", k, kind, name, line) for k, kind, name, line in (("a", "func", "foo", 10), ("b", "func", "foobar", 12), ("c", "gvar", "foo", 10), ("d", "func", "foo", 21), ("e", "type", "*T", 5), ("g", "func", "fo", 20))],
        "pair_id string, variant string, file string, node_key string, kind string, name string, debug_line int",
    )
    got = {r.node_key: (r.start, r.end, r.paint_seq) for r in intervals.tag_nodes(nodes, ranges).collect()}
    assert got == {"e": (5, 6, 1), "a": (10, 20, 2), "b": (10, 20, 3), "g": (10, 20, 4), "d": (10, 30, 5)}


SUB = "pair_id string, variant string, sub_id string, node_key string, dcb_id long, diff_type string, file string, start int, end int, seq int, desc_key string"


def part(variant, name, dcb, kind, key, start=1):
    return ("p", variant, f"{variant}{name}", name, dcb, kind, "f", start, start + 1, 1, key)


def test_matching_takes_the_first(spark):
    sub = spark.createDataFrame([part("A", "x1", 1, "+", "k", 1), part("A", "x2", 1, "+", "k", 2), part("B", "y1", 1, "+", "k"), part("B", "y2", 2, "+", "k")], SUB)
    got = hunkgraph.matches(sub)
    assert [(r.a, r.b) for r in got.collect()] == [("Ax1", "By1")]
    assert {r.sub_id for r in hunkgraph.unmatched(sub, got).collect()} == {"Ax2", "By2"}


def edges_of(spark, rows):
    return spark.createDataFrame([("p", v, f"{v}{a}", f"{v}{b}") for v, a, b in rows], "pair_id string, variant string, src string, dst string")


@pytest.mark.parametrize(
    "parts, edges, want",
    [
        ([("A", "a", 1, "+", "k"), ("B", "b", 1, "+", "k"), ("A", "p", 2, "-", "q")], [("A", "a", "p")], {"Aa", "Bb", "Ap"}),
        ([("A", "a", 1, "+", "k"), ("B", "b", 1, "+", "k"), ("A", "p", 2, "-", "q"), ("B", "p", 2, "-", "q")], [("A", "a", "p")], set()),
        ([("A", "a", 1, "+", "k"), ("B", "b", 1, "+", "k"), ("A", "p", 2, "#", "q")], [("A", "a", "p")], {"Aa", "Bb", "Ap"}),
        ([("A", "a", 1, "-", "k"), ("A", "p", 2, "+", "q")], [("A", "a", "p")], set()),
        ([("A", "a", 1, "#", "k"), ("A", "p", 2, "-", "q")], [("A", "a", "p")], {"Aa", "Ap"}),
    ],
)
def test_violations(spark, parts, edges, want):
    sub = spark.createDataFrame([part(*p) for p in parts], SUB)
    e = edges_of(spark, edges)
    units = hunkgraph.units(sub, hunkgraph.matches(sub)).cache()
    flags = violation.flagged(units, e)
    assert {r.sub_id for r in flags.collect()} == want
    kept = {r.unit: (r.ka, r.kb) for r in violation.kept_units(units, flags).collect()}
    if parts[0][3] == "-":
        assert "Aa" not in kept and violation.merged_edges(units, e, flags).isEmpty()
    elif len(parts) == 3 and parts[2][3] == "-":
        assert kept["Aa"] == ("Aa", "Bb") and [(r.src, r.dst) for r in violation.merged_edges(units, e, flags).collect()] == [("Aa", "Ap")]


def model(parts, edges):
    """Flags, kept units and merged edges by walking over units."""
    kind = {f"{p[0]}{p[1]}": p[3] for p in parts}
    place = {(p[0], p[4], p[2]): f"{p[0]}{p[1]}" for p in reversed(parts)}
    pairs = [(place["A", k, d], place["B", k, d]) for v, k, d in place if v == "A" and ("B", k, d) in place]
    unit = {x: (x if x[0] == "A" else None, x if x[0] == "B" else None) for x in kind}
    for a, b in pairs:
        unit[a] = unit[b] = (a, b)
    lone = lambda x: None in unit[x]
    out = {}
    for v, a, b in edges:
        out.setdefault(f"{v}{a}", set()).add(f"{v}{b}")
    flags = set()
    for a, b in set(unit.values()):
        t = kind[a or b]
        if t == "#":
            flags |= {x for x in (a, b) if x}
            flags |= {p for p in out.get(a, ()) if kind[p] == "-" and lone(p)} | {p for p in out.get(b, ()) if kind[p] == "+" and lone(p)}
            continue
        for p in out.get(b if t == "-" else a, ()):
            if lone(p) and kind[p] != t:
                flags |= {x for x in (a, b) if x} | ({p} if kind[p] != "#" else set())
    kept = {}
    for a, b in set(unit.values()):
        multi = a in flags or b in flags
        stay = tuple(x if multi or (kind[a or b] == "-") == (k == 1) else None for k, x in enumerate((a, b)))
        if any(stay):
            kept[a, b] = stay
    merged = {(a or b, q[0] or q[1]) for (a, b), stay in kept.items() for s in stay for p in out.get(s, ()) for q in [unit[p]] if q in kept}
    return flags, {a or b: s for (a, b), s in kept.items()}, merged


def test_random_graphs_against_a_walk(spark):
    r = random.Random(9)
    for _ in range(4):
        kinds = {d: r.choice("+-#") for d in range(12)}
        parts = [(v, f"n{k}", d, kinds[d], f"k{r.randint(0, 6)}") for v in "AB" for k in range(18) for d in [r.randint(0, 11)]]
        edges = sorted({(v, f"n{r.randint(0, 17)}", f"n{r.randint(0, 17)}") for v in "AB" for _ in range(30)})
        sub = spark.createDataFrame([part(*p, start=int(p[1][1:]) + 1) for p in parts], SUB)
        e = edges_of(spark, edges)
        units = hunkgraph.units(sub, hunkgraph.matches(sub)).cache()
        flags, kept, merged = model(parts, edges)
        got = violation.flagged(units, e).cache()
        assert {x.sub_id for x in got.collect()} == flags
        assert {x.unit: (x.ka, x.kb) for x in violation.kept_units(units, got).collect()} == kept
        assert {(x.src, x.dst) for x in violation.merged_edges(units, e, got).collect()} == merged
        # Swapping the sides swaps the outcome.
        swap = {"A": "B", "B": "A", "+": "-", "-": "+", "#": "#"}
        other = spark.createDataFrame([part(swap[p[0]], p[1], p[2], swap[p[3]], p[4], start=int(p[1][1:]) + 1) for p in parts], SUB)
        back = violation.flagged(hunkgraph.units(other, hunkgraph.matches(other)), edges_of(spark, [(swap[v], a, b) for v, a, b in edges]))
        assert {swap[x.sub_id[0]] + x.sub_id[1:] for x in back.collect()} == flags


def closure(edges):
    reach = {}
    for a, b in edges:
        reach.setdefault(a, set()).add(b)
        reach.setdefault(b, set())
    while True:
        more = {a: s | {y for x in s for y in reach[x]} for a, s in reach.items()}
        if more == reach:
            return reach
        reach = more


@pytest.mark.parametrize("largest", [10**6, 0])
def test_components_on_random_graphs(spark, largest, monkeypatch):
    if not largest:
        monkeypatch.setattr(components, "SMALL", 0)
    r = random.Random(4)
    names = [f"v{k:02}" for k in range(60)]
    edges = {(r.choice(names[:40]), r.choice(names[:40])) for _ in range(45)} | {(a, b) for a, b in zip(names[40:], names[41:])} | {("v59", "v40"), ("v10", "v10")}
    e = spark.createDataFrame(sorted(edges), "src string, dst string")
    reach = closure(edges)
    want = {v: min({v} | {w for w in s if v in reach[w]}) for v, s in reach.items()}
    assert {x.vertex: x.scc for x in cycles.strong_components(e, largest).collect()} == want
    both = closure(edges | {(b, a) for a, b in edges})
    weak = {x.vertex: x.component for x in components.components(e, "src", "dst").collect()}
    assert weak == {v: min(s | {v}) for v, s in both.items() if s - {v}}
    scc = spark.createDataFrame(sorted(want.items()), "vertex string, scc string")
    assert {tuple(x) for x in cycles.condensed_edges(e, scc).collect()} == {(want[a], want[b]) for a, b in edges if want[a] != want[b]}


def test_layers_against_the_queue(spark):
    r = random.Random(6)
    names_ = [f"v{k:02}" for k in range(60)]
    edges = sorted({(names_[min(a, b)], names_[max(a, b)]) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(70)) if a != b})
    v = spark.createDataFrame([(x, str(r.randrange(9))) for x in names_], "vertex string, key string")
    e = spark.createDataFrame(edges, "src string, dst string")
    one, other = (sorted(map(tuple, cycles.topological(v, e, k).collect())) for k in (10**6, 0))
    assert one == other and len(one) == 60


def test_rank_is_not_depth(spark):
    e = spark.createDataFrame([("r1", "y"), ("r1", "x"), ("r2", "x")], "src string, dst string")
    v = spark.createDataFrame([("r1", "1"), ("r2", "2"), ("x", "4"), ("y", "3"), ("z", "9")], "vertex string, key string")
    got = {x.vertex: (x.component, x["rank"], x.depth, x["pop"]) for x in cycles.topological(v, e).collect()}
    assert got == {"r1": ("r1", 0, 0, 0), "r2": ("r1", 0, 0, 1), "y": ("r1", 1, 1, 2), "x": ("r1", 2, 1, 3), "z": ("z", 0, 0, 0)}


def test_facts(spark):
    nodes = spark.createDataFrame([("p", "A", "m2", "k", "late"), ("p", "A", "m1", "k", "early"), ("p", "B", "m1", "k", "b")], "pair_id string, variant string, module_id string, node_key string, name string")
    assert {(r.variant, r.module_id, r["name"]) for r in facts.merge_nodes(nodes).collect()} == {("A", "m1", "early"), ("B", "m1", "b")}
    symbols = spark.createDataFrame([("func", "main", "external"), ("func", "f", "external"), ("func", "g", "internal"), ("gvar", "main", "external")], "sym_kind string, ext_name string, linkage string")
    assert {(r.sym_kind, r.ext_name) for r in facts.exported(symbols).collect()} == {("func", "f"), ("gvar", "main")}
    known = spark.createDataFrame([("func", "f", True), ("func", "g", False), ("gvar", "", True), ("gvar", "v", True), ("type", None, None)], "kind string, name string, is_defined boolean")
    assert {(r.kind, r["name"]) for r in facts.defined(known).collect()} == {("func", "f"), ("gvar", "v"), ("type", None)}
    calls = spark.createDataFrame(
        [("p", "A", "s", d, c, *x) for d, c, x in (("d1", "f", (True, True, "f", True, False)), ("d2", "g", (True, True, "", True, False)), ("d3", "h", (True, False, "h", True, False)), (None, "i", (False, False, None, True, False)),
                                                ("s", "s", (True, True, "s", True, False)), ("d4", "j", (True, True, "j", False, False)), ("d5", "k", (True, True, "k", True, True)))],
        "pair_id string, variant string, src_key string, dst_key string, callee string, callee_defined boolean, debug_ok boolean, sub_name string, is_direct boolean, is_intrinsic boolean",
    )
    inside, by_name = facts.callee_links(calls)
    assert {r.dst_key for r in inside.collect()} == {"d1"} and {r.ext_name for r in by_name.collect()} == {"h", "i"}
    listing = spark.createDataFrame([("@r@src@a$c",)], "name string")
    files = spark.createDataFrame([("src/a.c",), ("src/b.c",)], "file string")
    assert [r.file for r in facts.select_modules(files, listing, "/r").collect()] == ["src/a.c"]


def test_types(spark):
    types = spark.createDataFrame(
        [(1, "composite", None, "X", None, None, True, False), (2, "derived", "pointer", None, None, 1, True, False), (3, "derived", "const", None, None, 2, True, False), (4, "derived", "typedef", "T", None, 3, True, False), (5, "derived", "pointer", None, None, 1, False, False),
         (6, "composite", None, "Fwd", None, None, True, True), (7, "derived", "pointer", None, None, 6, True, False), (8, "basic", None, "int", None, None, True, False), (9, "subroutine", None, None, None, None, True, False), (10, "derived", "pointer", None, None, 9, True, False),
         (11, "composite", None, None, None, None, True, False), (12, "derived", "pointer", None, None, 13, True, False), (13, "derived", "pointer", None, None, 12, True, False)],
        "type_id long, kind string, tag string, name string, identifier string, base_id long, inside boolean, is_decl boolean",
    )
    assert {r.type_id: r.base for r in facts.resolve_types(types).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 9: 9, 10: 9, 11: 11}
    members = spark.createDataFrame([(9, 3), (9, 8), (9, 11), (11, 4), (11, 10)], "type_id long, member_id long")
    flat = facts.flatten_types(types, members)
    got = {}
    for r in flat.collect():
        got.setdefault(r.type_id, set()).add(r.leaf)
    assert got == {1: {1}, 2: {1}, 3: {1}, 4: {4}, 9: {1, 4}, 10: {1, 4}, 11: {1, 4}}
    uses = spark.createDataFrame([("p", "A", "f", 10)], "pair_id string, variant string, src_key string, type_id long")
    keys = spark.createDataFrame([(1, "tx"), (4, "tt")], "type_id long, node_key string")
    assert {(r.dst_key, r.dep_kind) for r in facts.type_edges(uses, flat, keys, "func_type_proto").collect()} == {("tx", "func_type_proto"), ("tt", "func_type_proto")}


def test_types_nest_to_any_depth(spark):
    # A chain of 300 pointers, 200 nameless composites that hold each other, a circle of three, and what leads into it.
    rows = [(0, "composite", "X", None)] + [(k, "derived", None, k - 1) for k in range(1, 301)] + [(k, "composite", None, None) for k in range(1000, 1200)]
    rows += [(2000 + k, "derived", None, 2000 + (k + 1) % 3) for k in range(3)] + [(2003, "derived", None, 2000)]
    types = spark.createDataFrame([(i, kind, "pointer" if kind == "derived" else None, name, None, base, True, False) for i, kind, name, base in rows], "type_id long, kind string, tag string, name string, identifier string, base_id long, inside boolean, is_decl boolean")
    base = {r.type_id: r.base for r in facts.resolve_types(types).collect()}
    assert base == {k: 0 for k in range(301)} | {k: k for k in range(1000, 1200)}
    members = spark.createDataFrame([(k, k + 1) for k in range(1000, 1199)] + [(1199, 300), (1199, 1000)], "type_id long, member_id long")
    assert {(r.type_id, r.leaf) for r in facts.flatten_types(types, members).collect()} == {(k, 0) for k in base}
    calls = members.selectExpr("type_id", "cast(0 as int) as seq", "member_id").limit(0)
    reps = {r.type_id: r.rep for r in names.prototypes(types, calls).collect()}
    assert reps == {k: "[*" * k + "[X]" + "]" * k for k in range(301)}


def test_report(spark):
    nodes = paint(spark, [("A", "f.c", "n1", 1, 10, 1, "k1"), ("B", "f.c", "n1", 1, 11, 1, "k1"), ("A", "f.c", "n2", 30, 40, 2, "k2"), ("B", "f.c", "n3", 50, 60, 3, "k3")])
    hunks = hunk_rows(spark, [(1, "f.c", "+", 3, 3, 3, 0), (2, "f.c", "#", 31, 2, 31, 2), (3, "f.c", "-", 52, 0, 52, 4), (4, "f.c", "+", 2, 1, 2, 2)])
    deps = spark.createDataFrame([("p", "A", "n1", "n2"), ("p", "B", "n3", "n1")], "pair_id string, variant string, src_key string, dst_key string")
    a = analysis.analyse(nodes, hunks, deps)
    out = analysis.suggest(a, hunks)
    lines = [r.line for r in out.lines.orderBy("group_id", "scc_seq", "item_seq").collect()]
    assert lines == [
        "[output] Group 0",
        "    [output] Rank -> 3, Scc has 1 items",
        "        [output] CB Type: Conflict, filepath = f.c, change(31, 32)  in DCB_A(31, 32) >>>>> DCB_B(31, 32)",
        "    [output] Rank -> 2, Scc has 1 items",
        "        [output] CB Type: Apply A, filepath = f.c, change(2, 2) in DCB_A(2, 2) >>>>> change(2, 3) in DCB_B(2, 3)",
    ]
    assert [(r.va, r.vb) for r in out.added.collect()] == [(1, 2)]
    assert report.empty_report(a.kept, hunks).isEmpty()
    nothing = spark.createDataFrame([], a.kept.schema)
    assert [tuple(r) for r in report.empty_report(nothing, hunks).collect()] == [("p", "xxx")]


def test_rows_in_any_order_give_the_same(spark):
    sf = "/root/testdata/sf0.001"
    n, h, d = standin.nodes(spark, sf), standin.hunks(spark, sf), standin.module_deps(spark, sf)
    one = analysis.suggest(analysis.analyse(n, h, d), h).lines
    two = analysis.suggest(analysis.analyse(n.repartition(7), h.repartition(3), d.repartition(5)), h).lines
    rows = sorted(map(tuple, one.collect()))
    assert rows and rows == sorted(map(tuple, two.collect()))


def test_plans_have_no_nested_loops(spark):
    sf = "/root/testdata/sf0.001"
    n, h = standin.nodes(spark, sf), standin.hunks(spark, sf)
    for df in (intervals.map_hunks(n, h), intervals.tag_nodes(n.drop("start", "end", "paint_seq"), standin.ranges(spark, sf)), hunkgraph.matches(hunkgraph.sub_nodes(intervals.map_hunks(n, h), n, h))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in standin.nodes(spark, sf)._jdf.queryExecution().executedPlan().toString()
