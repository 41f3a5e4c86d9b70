"""Queries over the stand-in tables, by name, and the same in SQL.

The SQL comes from plain readings of the rules: lines one by one instead of segments, recursive
closure instead of contraction.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from hunkwise.functions import names, paths, stats
from hunkwise.operators import components, cycles, facts, hunkgraph, intervals, report, violation
from hunkwise.plans import analysis, standin
from hunkwise.session import cut, ship
from hunkwise.sources import ir, sinks, text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(ship(spark), sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return add


_COLUMNS = """
nodes AS (
  SELECT 'A' AS variant, o_orderkey // 100 AS file, o_orderkey AS node_key, o_orderkey % 3 AS k,
         1 + (o_orderkey * 37) % 300 AS start, 1 + (o_orderkey * 37) % 300 + o_orderkey % 12 AS "end",
         (1 + (o_orderkey * 37) % 300) * 1000000 + o_orderkey AS paint_seq
  FROM orders
  UNION ALL
  SELECT 'B', o_orderkey // 100, o_orderkey, o_orderkey % 3,
         1 + (o_orderkey * 37) % 300 + (o_orderkey // 100) % 5, 1 + (o_orderkey * 37) % 300 + (o_orderkey // 100) % 5 + o_orderkey % 12,
         (1 + (o_orderkey * 37) % 300) * 1000000 + o_orderkey
  FROM orders WHERE o_orderstatus <> 'F'
), n_files AS (SELECT greatest(1, count(*) // 100) AS f FROM orders),
dcb AS (
  SELECT p_partkey AS dcb_id, p_partkey % f AS file, ['+', '-', '#'][(p_partkey + p_partkey // f) % 3 + 1] AS diff_type,
         1 + ((p_partkey // f) * 23 + p_partkey) % 300 AS start_a, (p_size * 3) % 40 AS len_a,
         1 + ((p_partkey // f) * 23 + p_partkey) % 300 + (p_partkey % f) % 5 AS start_b, (p_size * 7) % 40 AS len_b
  FROM part CROSS JOIN n_files
), sides AS (
  SELECT 'A' AS variant, file, dcb_id, diff_type, start_a AS h_start, len_a AS h_len FROM dcb
  UNION ALL SELECT 'B', file, dcb_id, diff_type, start_b, len_b FROM dcb
), deps AS (
  SELECT DISTINCT l_orderkey AS src_key, (l_orderkey // 100) * 100 + (l_orderkey % 100 + 97 + CASE WHEN (l_partkey + l_suppkey) % 8 = 0 THEN l_partkey % 7 ELSE 3 END) % 100 AS dst_key
  FROM lineitem
), lines AS (
  SELECT variant, file, line, arg_max(node_key, paint_seq) AS node_key
  FROM (SELECT variant, file, node_key, paint_seq, unnest(generate_series(start, "end")) AS line FROM nodes) GROUP BY ALL
), mapped AS (
  SELECT DISTINCT l.variant, l.file, l.node_key, h.dcb_id
  FROM (SELECT *, unnest(generate_series(h_start, h_start + h_len - 1)) AS line FROM sides WHERE h_len > 0) h
  JOIN lines l ON l.variant = h.variant AND l.file = h.file AND l.line = h.line
), sub AS (
  SELECT m.variant, m.variant || '|' || m.node_key || '|' || m.dcb_id AS sub_id, m.node_key, m.dcb_id, h.diff_type, m.file,
         greatest(n.start, h.h_start) AS start, least(n."end", h.h_start + h.h_len - 1) AS "end",
         row_number() OVER (PARTITION BY m.variant, m.node_key ORDER BY h.h_start, m.dcb_id) AS seq,
         m.file || '|' || m.node_key % 50 AS desc_key
  FROM mapped m JOIN nodes n ON n.variant = m.variant AND n.node_key = m.node_key
  JOIN sides h ON h.variant = m.variant AND h.dcb_id = m.dcb_id
), chain AS (
  SELECT * FROM (SELECT variant, sub_id AS src, lag(sub_id) OVER (PARTITION BY variant, node_key ORDER BY seq) AS dst FROM sub) WHERE dst IS NOT NULL
), ends AS (
  SELECT variant, node_key, arg_min(sub_id, seq) AS first, arg_max(sub_id, seq) AS last FROM sub GROUP BY ALL
), edges AS (
  SELECT * FROM chain UNION
  SELECT s.variant, s.first, d.last FROM deps JOIN ends s ON s.node_key = src_key JOIN ends d ON d.node_key = dst_key AND d.variant = s.variant
), firsts AS (
  SELECT * FROM sub QUALIFY row_number() OVER (PARTITION BY variant, desc_key, dcb_id ORDER BY start, node_key) = 1
), matched AS (
  SELECT a.sub_id AS a, b.sub_id AS b FROM firsts a JOIN firsts b ON a.desc_key = b.desc_key AND a.dcb_id = b.dcb_id
  WHERE a.variant = 'A' AND b.variant = 'B'
), lone AS (
  SELECT * FROM sub WHERE sub_id NOT IN (SELECT a FROM matched UNION ALL SELECT b FROM matched)
), units AS (
  SELECT a AS unit, a, b, diff_type FROM matched JOIN sub ON sub_id = a
  UNION ALL SELECT sub_id, CASE variant WHEN 'A' THEN sub_id END, CASE variant WHEN 'B' THEN sub_id END, diff_type FROM lone
), members AS (
  SELECT a AS sub_id, unit FROM units WHERE a IS NOT NULL UNION ALL SELECT b, unit FROM units WHERE b IS NOT NULL
), needs AS (
  SELECT u.unit, u.a, u.b, u.diff_type, e.variant, p.sub_id AS p, p.diff_type AS p_type
  FROM units u JOIN edges e ON (e.variant = 'A' AND e.src = u.a) OR (e.variant = 'B' AND e.src = u.b) JOIN lone p ON p.sub_id = e.dst
), by_conflict AS (
  SELECT a AS sub_id FROM units WHERE diff_type = '#' AND a IS NOT NULL
  UNION SELECT b FROM units WHERE diff_type = '#' AND b IS NOT NULL
  UNION SELECT p FROM needs WHERE diff_type = '#' AND ((variant = 'A' AND p_type = '-') OR (variant = 'B' AND p_type = '+'))
), taken AS (
  SELECT * FROM needs WHERE (diff_type = '+' AND variant = 'A' AND p_type <> '+') OR (diff_type = '-' AND variant = 'B' AND p_type <> '-')
), by_applied AS (
  SELECT a AS sub_id FROM taken WHERE a IS NOT NULL UNION SELECT b FROM taken WHERE b IS NOT NULL
  UNION SELECT p FROM taken WHERE p_type <> '#'
), flags AS (SELECT * FROM by_conflict UNION SELECT * FROM by_applied),
kept AS (
  SELECT unit, a, b, diff_type, CASE WHEN multi OR diff_type <> '-' THEN a END AS ka, CASE WHEN multi OR diff_type = '-' THEN b END AS kb, multi
  FROM (SELECT *, coalesce(a IN (SELECT sub_id FROM flags), false) OR coalesce(b IN (SELECT sub_id FROM flags), false) AS multi FROM units)
  WHERE CASE WHEN multi OR diff_type <> '-' THEN a END IS NOT NULL OR CASE WHEN multi OR diff_type = '-' THEN b END IS NOT NULL
), merged AS (
  SELECT DISTINCT k.unit AS src, m.unit AS dst
  FROM kept k JOIN edges e ON e.src = k.ka OR e.src = k.kb JOIN members m ON m.sub_id = e.dst JOIN kept t ON t.unit = m.unit
)"""

_REACH = _COLUMNS + """, reach AS (
  SELECT src AS v, dst AS w FROM merged UNION SELECT r.v, m.dst FROM reach r JOIN merged m ON m.src = r.w
), vertices AS (SELECT src AS v FROM merged UNION SELECT dst FROM merged),
scc AS (
  SELECT v.v AS vertex, least(v.v, coalesce(min(x.w), v.v)) AS scc
  FROM vertices v LEFT JOIN (SELECT r.v, r.w FROM reach r JOIN reach q ON q.v = r.w AND q.w = r.v) x ON x.v = v.v GROUP BY v.v
), condensed AS (
  SELECT DISTINCT s.scc AS src, d.scc AS dst FROM merged m JOIN scc s ON s.vertex = m.src JOIN scc d ON d.vertex = m.dst WHERE s.scc <> d.scc
)"""


def _with(tail: str, base: str = _COLUMNS) -> str:
    return f"WITH RECURSIVE {base}\n{tail}"


def _analysis(spark: SparkSession, sf_dir: str) -> tuple[analysis.Analysis, DataFrame]:
    hunks = standin.hunks(spark, sf_dir)
    return analysis.analyse(standin.nodes(spark, sf_dir), hunks, standin.module_deps(spark, sf_dir)), hunks


def _sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, h = standin.nodes(spark, sf_dir), standin.hunks(spark, sf_dir)
    return hunkgraph.sub_nodes(intervals.map_hunks(n, h), n, h)


@query(_with("SELECT variant, node_key, dcb_id FROM mapped"))
def dcb_node_map(spark, sf_dir):
    return intervals.map_hunks(standin.nodes(spark, sf_dir), standin.hunks(spark, sf_dir)).select("variant", "node_key", "dcb_id")


@query(_with("SELECT variant, node_key, count(*) AS n_lines FROM lines GROUP BY ALL"))
def visible_segments(spark, sf_dir):
    seen = intervals.visible_segments(standin.nodes(spark, sf_dir))
    return seen.groupBy("variant", "node_key").agg(F.sum(F.col("end") - F.col("start") + 1).cast("long").alias("n_lines"))


@query("""
WITH n AS (SELECT o_orderkey AS node_key, o_orderkey // 100 AS file, ['func', 'gvar', 'type'][o_orderkey % 3 + 1] AS kind, 'sym_' || o_orderkey AS name,
  1 + (o_orderkey * 37) % 300 AS start, 1 + (o_orderkey * 37) % 300 + o_orderkey % 12 AS "end" FROM orders),
r AS (SELECT file, start * 1000000 + node_key AS range_seq, kind, start - node_key % 3 + 1 AS r_start, "end" + node_key % 2 AS r_end,
  CASE WHEN node_key % 10 = 0 THEN '' WHEN node_key % 4 = 0 THEN 'sym_' ELSE name END AS r_name FROM n),
m AS (SELECT n.node_key, n.file, n.name, n.start AS line, r.r_start, r.r_end, row_number() OVER (PARTITION BY n.node_key ORDER BY r.range_seq) AS k
  FROM n JOIN r ON n.file = r.file AND n.kind = r.kind AND n.start BETWEEN r.r_start AND r.r_end AND (contains(n.name, r.r_name) OR contains(r.r_name, n.name)))
SELECT node_key, CAST(r_start AS BIGINT) AS start, CAST(r_end AS BIGINT) AS "end", row_number() OVER (PARTITION BY file ORDER BY line, length(name), name, node_key) AS paint_seq FROM m WHERE k = 1
""")
def node_range_tag(spark, sf_dir):
    n = standin.nodes(spark, sf_dir).filter("variant = 'A'").drop("start", "end", "paint_seq", "desc_key")
    return intervals.tag_nodes(n, standin.ranges(spark, sf_dir)).select("node_key", "start", "end", "paint_seq")


@query(_with('SELECT sub_id, start, "end", seq FROM sub'))
def subnode_bounds(spark, sf_dir):
    return _sub(spark, sf_dir).select("sub_id", "start", "end", "seq")


@query(_with("SELECT src, dst FROM chain"))
def subnode_chain(spark, sf_dir):
    return hunkgraph.chain_edges(_sub(spark, sf_dir)).select("src", "dst")


@query(_with("SELECT src, dst FROM edges"))
def hunk_edges(spark, sf_dir):
    return hunkgraph.hunk_edges(cut(_sub(spark, sf_dir), "sub"), standin.module_deps(spark, sf_dir)).select("src", "dst")


@query("""SELECT l_orderkey AS node_key, CAST(min(l_linenumber) AS BIGINT) AS module_id,
  arg_min('m' || l_linenumber || '_' || l_partkey, (l_linenumber, 'm' || l_linenumber || '_' || l_partkey)) AS name FROM lineitem GROUP BY l_orderkey""")
def module_merge(spark, sf_dir):
    return facts.merge_nodes(standin.module_nodes(spark, sf_dir)).select("node_key", "module_id", "name")


@query("""SELECT ['func_type_proto', 'func_type_body', 'func_gvar', 'func_func', 'type_type', 'gvar_type'][l_linenumber % 6 + 1] AS dep_kind,
  count(DISTINCT (l_orderkey, (l_orderkey // 100) * 100 + (l_orderkey % 100 + 97 + CASE WHEN (l_partkey + l_suppkey) % 8 = 0 THEN l_partkey % 7 ELSE 3 END) % 100)) AS n
  FROM lineitem GROUP BY 1""")
def dep_union(spark, sf_dir):
    return facts.merge_edges(standin.module_deps(spark, sf_dir).filter("variant = 'A'")).groupBy("dep_kind").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_orderkey // 100 AS file, o_orderkey AS node_key FROM orders")
def file_node_union(spark, sf_dir):
    twice = standin.nodes(spark, sf_dir)
    return facts.file_nodes(twice.unionByName(twice).withColumn("variant", F.lit("A"))).select("file", "node_key")


@query("SELECT l_orderkey AS src_key, count(DISTINCT l_suppkey % 60) AS n_names FROM lineitem GROUP BY 1")
def wait_list_union(spark, sf_dir):
    return facts.wait_lists(standin.ext_refs(spark, sf_dir)).groupBy("src_key").agg(F.count("*").alias("n_names"))


@query("""WITH e AS (SELECT 's' || s_suppkey % 40 AS ext_name, arg_min(s_suppkey, (s_nationkey, s_suppkey)) AS dst_key FROM supplier GROUP BY 1)
SELECT DISTINCT l_orderkey AS src_key, dst_key FROM lineitem JOIN e ON ext_name = 's' || l_suppkey % 60""")
def external_link(spark, sf_dir):
    return facts.link_externals(standin.ext_refs(spark, sf_dir), standin.externals(spark, sf_dir)).select("src_key", "dst_key")


@query("SELECT DISTINCT l_orderkey AS src_key, l_partkey AS dst_key, l_partkey < (SELECT count(*) FROM orders) // 2 AS known FROM lineitem")
def internal_link(spark, sf_dir):
    refs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit(standin.PAIR).alias("pair_id"), F.lit("A").alias("variant"), F.col("l_orderkey").alias("src_key"), F.col("l_partkey").alias("dst_key"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    half = orders.count() // 2
    known = orders.filter(F.col("o_orderkey") < half).select(F.lit(standin.PAIR).alias("pair_id"), F.lit("A").alias("variant"), F.col("o_orderkey").alias("node_key"))
    found, missing = facts.link_internals(refs, known)
    return found.select("src_key", "dst_key", F.lit(True).alias("known")).unionByName(missing.select("src_key", "dst_key", F.lit(False).alias("known")))


@query(_with("SELECT a, b FROM matched"))
def node_match(spark, sf_dir):
    return hunkgraph.matches(_sub(spark, sf_dir)).select("a", "b")


@query(_with("SELECT variant, sub_id FROM lone"))
def unmatched(spark, sf_dir):
    sub = cut(_sub(spark, sf_dir), "sub")
    return hunkgraph.unmatched(sub, hunkgraph.matches(sub)).select("variant", "sub_id")


@query(_with("SELECT sub_id FROM by_conflict"))
def flagged_conflict(spark, sf_dir):
    a, _ = _analysis(spark, sf_dir)
    return violation.flagged_by_conflicts(a.units, a.edges).select("sub_id")


@query(_with("SELECT sub_id FROM by_applied"))
def flagged_apply(spark, sf_dir):
    a, _ = _analysis(spark, sf_dir)
    return violation.flagged_by_applied(a.units, a.edges).select("sub_id")


@query(_with("SELECT unit, ka, kb, multi FROM kept"))
def merged_units(spark, sf_dir):
    a, _ = _analysis(spark, sf_dir)
    return a.kept.select("unit", "ka", "kb", "multi")


@query(_with("SELECT src, dst FROM merged"))
def merged_edges(spark, sf_dir):
    return _analysis(spark, sf_dir)[0].merged.select("src", "dst")


@query(_with("""SELECT v AS vertex, min(w) AS component FROM walk GROUP BY v""", _COLUMNS + """, both_ways AS (SELECT src, dst FROM merged WHERE src <> dst UNION SELECT dst, src FROM merged WHERE src <> dst),
walk AS (SELECT src AS v, src AS w FROM both_ways UNION SELECT walk.v, dst FROM walk JOIN both_ways ON src = walk.w)"""))
def wcc(spark, sf_dir):
    return components.components(_analysis(spark, sf_dir)[0].merged, "src", "dst")


@query(_with("SELECT vertex, scc FROM scc", _REACH))
def scc(spark, sf_dir):
    return cycles.strong_components(_analysis(spark, sf_dir)[0].merged)


@query(_with("SELECT src, dst FROM condensed", _REACH))
def condensed_edges(spark, sf_dir):
    merged = cut(_analysis(spark, sf_dir)[0].merged, "merged")
    return cycles.condensed_edges(merged, cycles.strong_components(merged))


@query(_with("SELECT dst AS vertex, count(*) AS in_degree FROM condensed GROUP BY dst", _REACH))
def in_degree(spark, sf_dir):
    merged = cut(_analysis(spark, sf_dir)[0].merged, "merged")
    return cycles.in_degree(cycles.condensed_edges(merged, cycles.strong_components(merged)))


@query(_with("SELECT vertex, CAST(max(d) AS BIGINT) AS depth FROM down GROUP BY vertex", _REACH + """, ones AS (SELECT unit AS vertex FROM kept WHERE unit NOT IN (SELECT vertex FROM scc) UNION SELECT scc FROM scc),
down AS (SELECT vertex, 0 AS d FROM ones UNION SELECT c.dst, d + 1 FROM down JOIN condensed c ON c.src = down.vertex)"""))
def topo_depth(spark, sf_dir):
    a, hunks = _analysis(spark, sf_dir)
    return analysis.suggest(a, hunks).order.select("vertex", "depth")


_ONES = """ones AS (SELECT unit AS vertex FROM kept WHERE unit NOT IN (SELECT vertex FROM scc) UNION SELECT scc FROM scc),
down AS (SELECT vertex, 0 AS d FROM ones UNION SELECT c.dst, d + 1 FROM down JOIN condensed c ON c.src = down.vertex),
deep AS (SELECT vertex, max(d) AS depth FROM down GROUP BY vertex),
both_ways AS (SELECT src, dst FROM condensed UNION SELECT dst, src FROM condensed),
walk AS (SELECT src AS v, src AS w FROM both_ways UNION SELECT walk.v, dst FROM walk JOIN both_ways ON src = walk.w),
placed AS (
  SELECT coalesce(s.scc, k.unit) AS vertex, arg_min(u.file || '|' || lpad(CAST(u.start AS VARCHAR), 12, '0'), (CAST(u.file AS BIGINT), u.start)) AS key
  FROM kept k LEFT JOIN scc s ON s.vertex = k.unit JOIN sub u ON u.sub_id = coalesce(k.ka, k.kb) GROUP BY 1
), tasks AS (
  SELECT p.vertex, p.key, d.depth, coalesce(c.component, p.vertex) AS component
  FROM placed p JOIN deep d USING (vertex) LEFT JOIN (SELECT v, min(w) AS component FROM walk GROUP BY v) c ON c.v = p.vertex
), layers AS (SELECT component, depth, sum(n) OVER (PARTITION BY component ORDER BY depth) - n AS before FROM (SELECT component, depth, count(*) AS n FROM tasks GROUP BY component, depth)),
-- A queue empties layer by layer of the longest path; in a layer, by the turn of the last one that was needed, then by key.
turns AS (
  SELECT component, vertex, 0 AS depth, CAST(0 AS BIGINT) AS rank, row_number() OVER (PARTITION BY component ORDER BY key, vertex) - 1 AS pop FROM tasks WHERE depth = 0
  UNION ALL
  SELECT n.component, n.vertex, n.depth, n.rank, l.before + row_number() OVER (PARTITION BY n.component ORDER BY n.rank, n.key, n.vertex) - 1
  FROM (SELECT t.component, t.vertex, t.key, t.depth, max(r.pop) + 1 AS rank FROM turns r JOIN condensed c ON c.src = r.vertex JOIN tasks t ON t.vertex = c.dst AND t.depth = r.depth + 1 GROUP BY t.component, t.vertex, t.key, t.depth) n
  JOIN layers l ON l.component = n.component AND l.depth = n.depth
)"""


@query(_with("SELECT vertex, component, CAST(rank AS BIGINT) AS rank, CAST(pop AS BIGINT) AS pop FROM turns", f"{_REACH}, {_ONES}"))
def topo_rank(spark, sf_dir):
    a, hunks = _analysis(spark, sf_dir)
    return analysis.suggest(a, hunks).order.select("vertex", "component", "rank", "pop")


_HIT = "hit AS (SELECT * FROM kept WHERE coalesce(ka IN (SELECT sub_id FROM flags), false) OR coalesce(kb IN (SELECT sub_id FROM flags), false))"


@query(_with("""SELECT CAST(coalesce(sum(len_a), 0) AS BIGINT) AS va, CAST(coalesce(sum(len_b), 0) AS BIGINT) AS vb FROM dcb
WHERE dcb_id IN (SELECT s.dcb_id FROM hit JOIN sub s ON s.sub_id = hit.unit WHERE hit.diff_type <> '#')""", f"{_COLUMNS}, {_HIT}"))
def eloc(spark, sf_dir):
    a, hunks = _analysis(spark, sf_dir)
    return analysis.suggest(a, hunks).added.agg(F.coalesce(F.sum("va"), F.lit(0)).alias("va"), F.coalesce(F.sum("vb"), F.lit(0)).alias("vb"))


@query(_with("""SELECT least(min(g.vertex), min(g.vertex)) AS component, scc, scc_size, count(*) AS n_items
FROM (SELECT h.unit, coalesce(s.scc, h.unit) AS scc, z.n AS scc_size, coalesce(c.component, coalesce(s.scc, h.unit)) AS vertex
  FROM hit h LEFT JOIN scc s ON s.vertex = h.unit
  JOIN (SELECT coalesce(s.scc, k.unit) AS scc, count(*) AS n FROM kept k LEFT JOIN scc s ON s.vertex = k.unit GROUP BY 1) z ON z.scc = coalesce(s.scc, h.unit)
  LEFT JOIN (SELECT v, min(w) AS component FROM walk GROUP BY v) c ON c.v = coalesce(s.scc, h.unit)) g GROUP BY scc, scc_size""",
    f"""{_REACH}, {_HIT}, both_ways AS (SELECT src, dst FROM condensed UNION SELECT dst, src FROM condensed),
walk AS (SELECT src AS v, src AS w FROM both_ways UNION SELECT walk.v, dst FROM walk JOIN both_ways ON src = walk.w)"""))
def group_report(spark, sf_dir):
    a, hunks = _analysis(spark, sf_dir)
    return analysis.suggest(a, hunks).items.groupBy("component", "scc", "scc_size").agg(F.count("*").alias("n_items"))


_LINES = f"""{_REACH}, {_ONES}, {_HIT},
each AS (
  SELECT k.unit, k.diff_type, k.ka, k.kb, t.vertex AS scc, t.component, r.rank, r.pop, coalesce(a.file, b.file) AS file, coalesce(a.start, b.start) AS line_at,
         count(*) OVER (PARTITION BY t.vertex) AS scc_size, h.start_a, h.start_a + h.len_a - 1 AS end_a, h.start_b, h.start_b + h.len_b - 1 AS end_b, h.dcb_id,
         a.start AS a0, a."end" AS a1, b.start AS b0, b."end" AS b1
  FROM kept k LEFT JOIN scc s ON s.vertex = k.unit JOIN tasks t ON t.vertex = coalesce(s.scc, k.unit) JOIN turns r ON r.vertex = t.vertex
  LEFT JOIN sub a ON a.sub_id = k.ka LEFT JOIN sub b ON b.sub_id = k.kb JOIN dcb h ON h.dcb_id = coalesce(a.dcb_id, b.dcb_id)
), first AS (SELECT component, min((file, line_at, unit)) AS place FROM each GROUP BY component),
item AS (
  SELECT e.*, dense_rank() OVER (ORDER BY f.place) - 1 AS group_id, dense_rank() OVER (PARTITION BY e.component ORDER BY pop DESC) - 1 AS scc_seq,
         row_number() OVER (PARTITION BY scc ORDER BY file, line_at, e.unit) - 1 AS item_seq,
         CASE diff_type WHEN '+' THEN 'Apply A' WHEN '-' THEN 'Apply B' ELSE 'Conflict' END AS said
  FROM each e JOIN first f USING (component) WHERE e.unit IN (SELECT unit FROM hit)
)"""


@query(_with("""SELECT group_id, scc_seq, rank, scc_size, item_seq, CASE
  WHEN ka IS NOT NULL AND kb IS NOT NULL THEN format('        [output] CB Type: {}, filepath = {}, change({}, {}) in DCB_A({}, {}) >>>>> change({}, {}) in DCB_B({}, {})', said, file, a0, a1, start_a, end_a, b0, b1, start_b, end_b)
  WHEN ka IS NOT NULL THEN format('        [output] CB Type: {}, filepath = {}, change({}, {})  in DCB_A({}, {}) >>>>> DCB_B({}, {})', said, file, a0, a1, start_a, end_a, start_b, end_b)
  ELSE format('        [output] CB Type: {} filepath = {}, DCB_A({}, {}) >>>>> change({}, {}) in DCB_B({}, {})', said, file, start_a, end_a, b0, b1, start_b, end_b) END AS line FROM item
UNION ALL SELECT DISTINCT group_id, scc_seq, rank, scc_size, -1, format('    [output] Rank -> {}, Scc has {} items', rank, scc_size) FROM item
UNION ALL SELECT DISTINCT group_id, -1, -1, -1, -1, format('[output] Group {}', group_id) FROM item""", _LINES))
def report_lines(spark, sf_dir):
    a, hunks = _analysis(spark, sf_dir)
    out = analysis.suggest(a, hunks).lines
    return out.select(*(F.col(c).cast("long").alias(c) for c in ("group_id", "scc_seq", "rank", "scc_size", "item_seq")), "line")


@query("""WITH n AS (SELECT o_orderkey AS node_key, o_orderkey // 100 AS file, ['func', 'gvar', 'type'][o_orderkey % 3 + 1] AS kind, 'sym_' || o_orderkey AS name,
  1 + (o_orderkey * 37) % 300 AS start, 1 + (o_orderkey * 37) % 300 + o_orderkey % 12 AS "end" FROM orders),
r AS (SELECT file, kind, start - node_key % 3 + 1 AS r_start, "end" + node_key % 2 AS r_end, CASE WHEN node_key % 10 = 0 THEN '' WHEN node_key % 4 = 0 THEN 'sym_' ELSE name END AS r_name FROM n)
SELECT file, count(*) AS total, count(*) FILTER (EXISTS (SELECT 1 FROM r WHERE r.file = n.file AND r.kind = n.kind AND n.start BETWEEN r.r_start AND r.r_end
  AND (contains(n.name, r.r_name) OR contains(r.r_name, n.name)))) AS tagged FROM n GROUP BY file""")
def file_stats(spark, sf_dir):
    n = standin.nodes(spark, sf_dir).filter("variant = 'A'").drop("start", "end", "paint_seq", "desc_key")
    return report.file_stats(n, intervals.tag_nodes(n, standin.ranges(spark, sf_dir))).select("file", "total", "tagged")


@query("SELECT ['func', 'gvar', 'type'][o_orderkey % 3 + 1] AS kind, count(*) AS n FROM orders GROUP BY 1")
def kind_counts(spark, sf_dir):
    return standin.nodes(spark, sf_dir).filter("variant = 'A'").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT page_id, replace(replace(url, '/', '@'), '.', '$') AS name FROM pages")
def path_encode(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", paths.encoded(F.col("url")).alias("name"))


_MESSY = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(f"""WITH RECURSIVE p AS (SELECT page_id, string_split('a/./b/../' || {_MESSY} || CASE page_id % 3 WHEN 0 THEN '/..' WHEN 1 THEN '/x/...' ELSE '/./y//z' END, '/') AS parts FROM pages),
w AS (SELECT page_id, parts, 1 AS i, CAST([] AS VARCHAR[]) AS acc FROM p
  UNION ALL SELECT page_id, parts, i + 1, CASE WHEN parts[i] IN ('', '.') THEN acc WHEN parts[i] = '..' THEN acc[1:greatest(len(acc) - 1, 0)] WHEN parts[i] = '...' THEN acc[1:greatest(len(acc) - 2, 0)] ELSE list_append(acc, parts[i]) END
  FROM w WHERE i <= len(parts))
SELECT page_id, '/' || array_to_string(acc, '/') AS path FROM w WHERE i > len(parts)""")
def path_normalize(spark, sf_dir):
    tail = F.when(F.col("page_id") % 3 == 0, "/..").when(F.col("page_id") % 3 == 1, "/x/...").otherwise("/./y//z")
    raw = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", paths.normalised(F.concat(F.lit("a/./b/../"), raw, tail)).alias("path"))


@query(f"""WITH RECURSIVE p AS (SELECT page_id, string_split(CASE WHEN page_id % 2 = 0 THEN 'r/' || substr({_MESSY}, length(split_part({_MESSY}, '/', 1)) + 2) ELSE 'other/' || {_MESSY} END, '/') AS parts FROM pages),
w AS (SELECT page_id, parts, 1 AS i, CAST([] AS VARCHAR[]) AS acc FROM p
  UNION ALL SELECT page_id, parts, i + 1, CASE WHEN parts[i] IN ('', '.') THEN acc WHEN parts[i] = '..' THEN acc[1:greatest(len(acc) - 1, 0)] WHEN parts[i] = '...' THEN acc[1:greatest(len(acc) - 2, 0)] ELSE list_append(acc, parts[i]) END
  FROM w WHERE i <= len(parts))
SELECT page_id, CASE WHEN acc[1] = 'r' AND len(acc) > 1 THEN array_to_string(acc[2:], '/') END AS file FROM w WHERE i > len(parts)""")
def path_base(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))
    host = F.substring_index("path", "/", 1)
    moved = p.select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/r/"), F.substring(F.col("path"), F.length(host) + 2, F.lit(1 << 20)))).otherwise(F.concat(F.lit("/other/"), "path")).alias("path"))
    return moved.select("page_id", paths.base_path(F.col("path"), F.lit(None).cast("string"), "/r").alias("file"))


@query(r"""SELECT page_id, regexp_matches(name, '\.(cc|cpp|hh|C|c|h|hpp|cxx|c\+\+)$') AS c_cpp, ends_with(name, '.java') AS java, ends_with(name, '.py') AS python
FROM (SELECT page_id, url || ['.cc', '.c++', '.java', '.py', '.C', '.hx', ''][page_id % 7 + 1] AS name FROM pages)""")
def suffix_filter(spark, sf_dir):
    tail = F.element_at(F.array(*map(F.lit, (".cc", ".c++", ".java", ".py", ".C", ".hx", ""))), (F.col("page_id") % 7 + 1).cast("int"))
    name = F.concat("url", tail)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", *(paths.has_suffix(name, k).alias(k) for k in ("c_cpp", "java", "python")))


@query(_with("""SELECT h.dcb_id, n.node_key, CASE WHEN h.h_start >= n.start AND h.h_start + h.h_len - 1 <= n."end" THEN 'INCLUDE'
  WHEN h.h_start > n."end" OR h.h_start + h.h_len - 1 < n.start THEN 'NOT_INCLUDE' ELSE 'PARTLY_INCLUDE' END AS relation
FROM sides h JOIN nodes n ON n.file = h.file AND n.variant = h.variant WHERE h.variant = 'A'"""))
def interval_relation(spark, sf_dir):
    h = intervals.hunk_sides(standin.hunks(spark, sf_dir)).filter("variant = 'A'")
    n = standin.nodes(spark, sf_dir).filter("variant = 'A'").select("file", "node_key", F.col("start").alias("s"), F.col("end").alias("e"))
    return h.join(n, "file").select("dcb_id", "node_key", names.relation(F.col("h_start"), F.col("h_end"), F.col("s"), F.col("e")).alias("relation"))


@query("""SELECT count(*) AS n, round(avg(d), 4) AS mean_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t
FROM (SELECT l_extendedprice - l_quantity * 1000 AS d FROM lineitem)""")
def paired_t(spark, sf_dir):
    out = stats.paired_t(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.col("l_extendedprice"), F.col("l_quantity") * 1000)
    return out.select("n", F.round("mean_diff", 4).alias("mean_diff"), F.round("t", 4).alias("t"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations""")
def header_carry(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return text.carried(rows, F.when(F.col("role") == "user", F.col("turn")), "asked", ["conv_id"], ["turn"]).select("conv_id", "turn", "asked")


@query("""SELECT user_id, event_id FROM (SELECT *, coalesce(max(CASE WHEN value < before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS gone
  FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) WHERE gone = 0""")
def prefix_cutoff(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "value")
    return text.before_decrease(rows, ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id")


@query("""SELECT 'f' || c_custkey AS file, CASE WHEN c_nationkey % 2 = 0 THEN '+' ELSE '-' END AS diff_type, CAST(1 AS INT) AS start_a, CAST(c_custkey % 90 AS INT) AS len_a, CAST(1 AS INT) AS start_b, CAST(c_custkey % 70 AS INT) AS len_b
FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def direct_merge_join(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    side = F.when(F.col("c_nationkey") % 2 == 0, "A").otherwise("B")
    merged = c.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.lit("l").alias("path"), key.alias("line_no"), F.concat(F.lit("f"), key.cast("string"), F.lit(" --- "), side).alias("line"))
    counted = c.select(key.alias("line_no"), F.format_string("f%d, %d, %d", key, key % 90, key % 70).alias("line"))
    out = sinks.whole_file_hunks(text.parse_direct_merges(merged), text.parse_line_counts(counted))
    return out.select("file", "diff_type", "start_a", "len_a", "start_b", "len_b")


@query(_with("""SELECT file, diff_type, CAST(start_a AS INT) AS start_a, CAST(len_a AS INT) AS len_a, CAST(start_b AS INT) AS start_b, CAST(len_b AS INT) AS len_b FROM (SELECT 'src/f' || file || '.c' AS file, diff_type, start_a, len_a, start_b, len_b FROM dcb)"""))
def hunk_round_trip(spark, sf_dir):
    """Hunks written as the lines of a hunk file and parsed again."""
    h = standin.hunks(spark, sf_dir).select(F.lit("x").alias("path"), F.col("file").cast("int").alias("header_seq"), F.col("dcb_id").cast("int").alias("hunk_seq"), F.format_string("src/f%d.c", "file").alias("file"), "diff_type", "start_a", "len_a", "start_b", "len_b")
    files = h.select("path", "header_seq", "file").distinct().withColumns({"lines_a": F.lit(400), "lines_b": F.lit(400)})
    lines = sinks.hunk_lines(files, h)
    numbered = lines.select(F.concat("path", F.lit("/"), F.col("header_seq").cast("string")).alias("path"), F.col("hunk_seq").alias("line_no"), "line")
    return text.parse_hunks(numbered).select("file", "diff_type", "start_a", "len_a", "start_b", "len_b")


@query("""SELECT p_partkey AS line_no, CAST(p_partkey % 50 + 1 AS INT) AS start_b, CAST(CASE WHEN p_size % 3 = 0 THEN 1 ELSE p_size END AS INT) AS len_b,
  CAST(p_partkey % 60 + 1 AS INT) AS start_a, CAST(CASE WHEN p_size % 4 = 0 THEN 1 ELSE p_size % 9 END AS INT) AS len_a FROM part""")
def diff_headers(spark, sf_dir):
    p, s = F.col("p_partkey"), F.col("p_size")
    minus = F.when(s % 3 == 0, F.format_string("-%d", p % 50 + 1)).otherwise(F.format_string("-%d,%d", p % 50 + 1, s))
    plus = F.when(s % 4 == 0, F.format_string("+%d", p % 60 + 1)).otherwise(F.format_string("+%d,%d", p % 60 + 1, s % 9))
    lines = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit("d").alias("path"), p.alias("line_no"), F.concat(F.lit("@@ "), minus, F.lit(" "), plus, F.lit(" @@ x")).alias("line"))
    return text.parse_diff(lines).select("line_no", "start_b", "len_b", "start_a", "len_a")


@query("SELECT 'c' || l_orderkey AS resolved, 'p' || min(l_linenumber) AS commit_a, 'p' || x AS commit_b FROM (SELECT l_orderkey, l_linenumber, unnest(list_filter(list_distinct(list(l_linenumber) OVER (PARTITION BY l_orderkey)), lambda y: true)) AS x FROM lineitem) GROUP BY l_orderkey, x HAVING x <> min(l_linenumber)")
def conflict_pairs(spark, sf_dir):
    """Merges from their list of parents, as (resolved, first parent, other parent)."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parents = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("p"))
    line = F.concat(F.lit("c"), F.col("l_orderkey").cast("string"), F.lit(" "), F.array_join(F.transform("p", lambda x: F.concat(F.lit("p"), x.cast("string"))), " "))
    return sinks.merge_tuples(text.parse_merges(parents.select(line.alias("line"))))


@query("SELECT o_orderkey AS node_key, CASE WHEN o_orderkey % 4 = 0 THEN 0 WHEN o_orderstatus = 'F' THEN -1 WHEN o_orderkey % 5 <> 0 THEN 1 ELSE 0 END AS state FROM orders")
def debug_state(spark, sf_dir):
    o = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(o.alias("node_key"), names.debug_state(o % 4 != 0, F.col("o_orderstatus") != "F", o % 5).alias("state"))


@query("""SELECT 'node without line or file' AS rule, CAST(o_orderkey AS VARCHAR) AS subject FROM orders WHERE 1 + (o_orderkey * 37) % 300 = 0
UNION ALL SELECT 'name defined twice in a module', 's' || s_suppkey % 40 FROM supplier GROUP BY s_nationkey, s_suppkey % 40 HAVING count(*) > 1""")
def fact_faults(spark, sf_dir):
    n = standin.nodes(spark, sf_dir).filter("variant = 'A'")
    return facts.faults(n.withColumn("file", F.col("file").cast("string")), standin.externals(spark, sf_dir)).select("rule", "subject")


_TYPES = """
types AS (
  SELECT p_partkey AS id, ['basic', 'subroutine', 'composite', 'derived', 'derived', 'derived', 'derived'][p_partkey % 7 + 1] AS kind,
    CASE WHEN p_partkey % 7 >= 3 THEN ['typedef', 'pointer', 'pointer', 'const', 'volatile'][p_partkey % 5 + 1] WHEN p_partkey % 7 = 2 AND p_partkey % 4 = 0 THEN 'array' ELSE 'other' END AS tag,
    CASE WHEN p_partkey % 7 = 2 AND p_partkey % 6 = 1 THEN '_Z' || p_partkey END AS identifier,
    CASE WHEN p_partkey % 7 = 0 THEN 'b' || p_partkey WHEN p_partkey % 7 = 2 AND p_partkey % 3 <> 0 THEN 'C' || p_partkey WHEN p_partkey % 7 >= 3 AND p_partkey % 5 = 0 THEN 'T' || p_partkey END AS name,
    CASE WHEN (p_partkey % 7 >= 3 OR (p_partkey % 7 = 2 AND p_partkey % 4 = 0)) AND p_partkey % 11 <> 0 AND p_partkey > 1 THEN p_partkey // 2 END AS base,
    p_partkey % 13 <> 0 AS inside, p_partkey % 17 = 0 AS is_decl
  FROM part
), members AS (
  SELECT id, 0 AS seq, CASE WHEN id % 10 <> 0 AND id > 3 THEN id // 3 END AS member FROM types WHERE kind IN ('subroutine', 'composite')
  UNION ALL SELECT id, 1, CASE WHEN id > 3 THEN id // 3 + 1 END FROM types WHERE kind IN ('subroutine', 'composite')
), resolved AS (
  SELECT id, id AS base FROM types WHERE kind = 'subroutine' OR (kind = 'composite' AND inside AND NOT is_decl) OR (kind = 'derived' AND inside AND tag = 'typedef')
  UNION ALL SELECT t.id, r.base FROM types t JOIN resolved r ON r.id = t.base WHERE t.kind = 'derived' AND t.inside AND t.tag <> 'typedef'
), opened AS (
  SELECT id FROM types WHERE kind = 'subroutine' OR (kind = 'composite' AND name IS NULL AND identifier IS NULL)
), flat AS (
  SELECT id, base FROM resolved
  UNION SELECT f.id, r.base FROM flat f JOIN opened o ON o.id = f.base JOIN members m ON m.id = f.base JOIN resolved r ON r.id = m.member
), leaves AS (SELECT id, base AS leaf FROM flat WHERE base NOT IN (SELECT id FROM opened))"""


@query(f"WITH RECURSIVE {_TYPES} SELECT id AS type_id, base FROM resolved")
def base_types(spark, sf_dir):
    return facts.resolve_types(standin.types(spark, sf_dir))


@query(f"WITH RECURSIVE {_TYPES} SELECT id AS type_id, leaf FROM leaves")
def flat_types(spark, sf_dir):
    return facts.flatten_types(standin.types(spark, sf_dir), standin.members(spark, sf_dir))


@query(f"""WITH RECURSIVE {_TYPES}
SELECT DISTINCT o_orderkey AS src_key, 't' || leaf AS dst_key, 'func_type_proto' AS dep_kind FROM orders JOIN leaves ON id = o_orderkey % (SELECT count(*) FROM part)""")
def type_dependencies(spark, sf_dir):
    kinds = standin.types(spark, sf_dir)
    n = kinds.count()
    uses = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit(standin.PAIR).alias("pair_id"), F.lit("A").alias("variant"), F.col("o_orderkey").alias("src_key"), (F.col("o_orderkey") % n).alias("type_id"))
    keys = kinds.select("type_id", F.concat(F.lit("t"), F.col("type_id").cast("string")).alias("node_key"))
    return facts.type_edges(uses, facts.flatten_types(kinds, standin.members(spark, sf_dir)), keys, "func_type_proto").select("src_key", "dst_key", "dep_kind")


@query(f"""WITH RECURSIVE {_TYPES},
named AS (SELECT *, CASE WHEN kind <> 'subroutine' THEN coalesce(CASE WHEN kind = 'composite' THEN identifier END, name) END AS label,
  CASE tag WHEN 'pointer' THEN '*' WHEN 'const' THEN 'const' WHEN 'volatile' THEN 'volatile' WHEN 'array' THEN '...' END AS lead FROM types),
kids AS (SELECT id, 0 AS seq, base AS kid FROM named WHERE label IS NULL AND kind <> 'subroutine' AND lead IS NOT NULL AND base IS NOT NULL
  UNION ALL SELECT m.id, m.seq, m.member FROM members m JOIN named n USING (id) WHERE n.kind = 'subroutine' AND m.member IS NOT NULL),
tree AS (SELECT id AS root, '' AS path, id FROM named UNION ALL SELECT root, path || '1' || seq, kid FROM tree JOIN kids USING (id)),
parts AS (
  SELECT root, path || '0' AS path, CASE WHEN label IS NOT NULL THEN '[' || label || ']' WHEN kind = 'subroutine' THEN '{{' WHEN lead IS NULL OR (base IS NULL AND lead = '...') THEN NULL WHEN base IS NULL THEN '[' || lead || '[void]]' ELSE '[' || lead END AS token
  FROM tree JOIN named USING (id)
  UNION ALL SELECT root, path || '2', CASE WHEN kind = 'subroutine' THEN '}}=' || (SELECT count(*) FROM kids k WHERE k.id = tree.id) ELSE ']' END
  FROM tree JOIN named USING (id) WHERE label IS NULL AND (kind = 'subroutine' OR (lead IS NOT NULL AND base IS NOT NULL)))
SELECT root AS type_id, string_agg(token, '' ORDER BY path) AS rep FROM parts GROUP BY root HAVING bool_and(token IS NOT NULL)""")
def prototype_rep(spark, sf_dir):
    return names.prototypes(standin.types(spark, sf_dir), standin.members(spark, sf_dir))


@query("""SELECT DISTINCT 'key' AS how, CAST(l_orderkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS target FROM lineitem
WHERE l_linenumber <> 5 AND l_suppkey % 9 <> 0 AND l_orderkey <> l_partkey AND l_linenumber % 2 = 0 AND l_orderkey % 3 <> 0 AND l_partkey % 4 <> 0
UNION ALL SELECT DISTINCT 'name', CAST(l_orderkey AS VARCHAR), 'c' || l_suppkey FROM lineitem
WHERE l_linenumber <> 5 AND l_suppkey % 9 <> 0 AND l_orderkey <> l_partkey AND NOT (l_linenumber % 2 = 0 AND l_orderkey % 3 <> 0)""")
def callee_links(spark, sf_dir):
    inside, by_name = facts.callee_links(standin.calls(spark, sf_dir))
    one = inside.select(F.lit("key").alias("how"), F.col("src_key").alias("src"), F.col("dst_key").alias("target"))
    return one.unionByName(by_name.select(F.lit("name").alias("how"), F.col("src_key").alias("src"), F.col("ext_name").alias("target")))


@query("""SELECT s_suppkey AS node_key, CASE WHEN s_nationkey % 2 = 0 THEN 'func' ELSE 'gvar' END AS sym_kind FROM supplier
WHERE s_suppkey % 3 <> 0 AND NOT (s_nationkey % 2 = 0 AND s_suppkey % 5 IN (0, 1))""")
def export_filter(spark, sf_dir):
    s = F.col("s_suppkey")
    name = F.when(s % 5 == 0, "main").when(s % 5 == 1, "LLVMFuzzerTestOneInput").otherwise(F.concat(F.lit("f"), s.cast("string")))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(s.alias("node_key"), F.when(F.col("s_nationkey") % 2 == 0, "func").otherwise("gvar").alias("sym_kind"), name.alias("ext_name"), F.when(s % 3 != 0, "external").otherwise("internal").alias("linkage"))
    return facts.exported(rows).select("node_key", "sym_kind")


@query("SELECT o_orderkey AS node_key FROM orders WHERE o_orderkey % 3 = 2 OR (o_orderstatus = 'O' AND (o_orderkey % 3 = 0 OR o_orderkey % 5 <> 0))")
def defined_nodes(spark, sf_dir):
    o = F.col("o_orderkey")
    name = F.when(o % 5 != 0, F.concat(F.lit("n"), o.cast("string")))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(o.alias("node_key"), F.element_at(F.array(*map(F.lit, standin.KINDS)), (o % 3 + 1).cast("int")).alias("kind"), name.alias("name"), (F.col("o_orderstatus") == "O").alias("is_defined"))
    return facts.defined(rows).select("node_key")


@query("SELECT 'src/f' || p_partkey || '.c' AS file FROM part WHERE p_partkey % 3 = 0 AND p_size > 10")
def module_selection(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    file = F.format_string("src/f%d.c", "p_partkey")
    listing = p.filter("p_size > 10").select(paths.encoded(F.concat(F.lit("/root/va/"), file)).alias("name"))
    return facts.select_modules(p.filter("p_partkey % 3 = 0").select(file.alias("file")), listing, "/root/va").select("file")


@query("""SELECT o_orderkey AS node_key, 'func|' || o_orderkey // 100 || '|' || o_orderkey % 300 || '|' || CASE WHEN o_orderkey % 2 = 0 THEN '_Z' || o_orderkey ELSE 'f' || o_orderkey END AS key,
  CASE WHEN o_orderkey % 4 = 0 THEN 'func|' || o_orderkey // 100 || '|f' || o_orderkey || '{}=0' ELSE 'func|' || o_orderkey // 100 || '|' || CASE WHEN o_orderkey % 2 = 0 THEN '_Z' || o_orderkey ELSE 'f' || o_orderkey END END AS desc_key,
  CASE WHEN o_orderkey % 7 = 0 THEN '*' ELSE 'f' || o_orderkey END AS shown FROM orders""")
def node_keys(spark, sf_dir):
    o = F.col("o_orderkey")
    plain = F.concat(F.lit("f"), o.cast("string"))
    link = names.link_name(F.when(o % 2 == 0, F.concat(F.lit("_Z"), o.cast("string"))).otherwise(""), plain)
    file = F.expr("o_orderkey div 100").cast("string")
    proto = F.when(o % 4 == 0, F.concat(plain, F.lit("{}=0")))
    shown = names.shown_name(F.when(o % 7 != 0, plain).otherwise(""))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(o.alias("node_key"), names.node_key(F.lit("func"), file, o % 300, link).alias("key"), names.desc_key(F.lit("func"), file, link, proto).alias("desc_key"), shown.alias("shown"))


@query("""SELECT p_partkey AS range_seq, ['func', 'composite', 'composite', 'gvar', 'alias'][p_partkey % 5 + 1] AS rtype, CAST(p_partkey % 40 AS INT) AS start, CAST(p_partkey % 40 + p_size AS INT) AS "end", 'n, ' || p_size AS name
FROM part WHERE p_partkey % 100 < 40 - p_partkey // 100 * 100 % 40""")
def range_parse(spark, sf_dir):
    """Range lines of one file for each hundred parts, read up to where start falls."""
    p = F.col("p_partkey")
    code = F.element_at(F.array(*map(F.lit, "fecgt")), (p % 5 + 1).cast("int"))
    line = F.format_string("%s, %d, %d, n, %d", code, p % 40, p % 40 + F.col("p_size"), "p_size")
    lines = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.expr("cast(p_partkey div 100 as string)").alias("path"), p.alias("line_no"), line.alias("line"))
    return text.parse_ranges(lines).select("range_seq", "rtype", "start", "end", "name")


@query("""SELECT c_custkey AS line_no, 'P' || c_custkey // 50 AS project, 'a' || c_custkey AS commit_a, 'b' || c_nationkey AS commit_b FROM customer WHERE c_custkey % 50 <> 0""")
def commit_pairs(spark, sf_dir):
    k = F.col("c_custkey")
    line = F.when(k % 50 == 0, F.format_string("P%d:", F.expr("c_custkey div 50"))).otherwise(F.format_string("a%d b%d", k, "c_nationkey"))
    lines = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit("l").alias("path"), k.alias("line_no"), line.alias("line"))
    return text.parse_commit_pairs(lines).select("line_no", "project", "commit_a", "commit_b")


@query("""SELECT p_partkey AS line_no, 'f' || p_partkey // 20 AS file, CASE p_partkey % 4 WHEN 1 THEN '#' WHEN 2 THEN '+' END AS diff_type, CAST(p_partkey AS INT) AS start_a, CAST(p_size AS INT) AS len_a, CAST(p_partkey + 1 AS INT) AS start_b, CAST(p_size % 7 AS INT) AS len_b
FROM part WHERE p_partkey % 20 <> 0""")
def truth_blocks(spark, sf_dir):
    p, s = F.col("p_partkey"), F.col("p_size")
    forms = ("    %d, %d, = %d, %d", "# %d, %d, = ,%d, %d", "+ %d,, %d = %d, %d, ", "  %d, %d = ,%d, %d")
    block = F.element_at(F.array(*[F.format_string(f, p, s, p + 1, s % 7) for f in forms]), (p % 4 + 1).cast("int"))
    line = F.when(p % 20 == 0, F.format_string("f%d", F.expr("p_partkey div 20"))).otherwise(block)
    lines = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit("g").alias("path"), p.alias("line_no"), line.alias("line"))
    return text.parse_truth(lines).select("line_no", "file", "diff_type", "start_a", "len_a", "start_b", "len_b")


@query("""SELECT page_id, substr('/' || CASE WHEN page_id % 2 = 0 THEN 'r/' ELSE '' END || 'f' || page_id % 40, 4) AS file FROM pages WHERE page_id % 2 = 0 AND page_id % 40 < 20""")
def project_files(spark, sf_dir):
    """Pages as sources, below the root or beside it; half of the files were modified."""
    k = F.col("page_id")
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(k, F.format_string("x/../f%d", k % 40).alias("path"), F.when(k % 2 == 0, "/r").otherwise("/other").alias("folder"))
    modified = rows.select(F.format_string("f%d", k % 40).alias("file"), (k % 40).alias("n")).filter("n < 20")
    return paths.in_project(rows, modified, "/r").select("page_id", "file")


@query("SELECT 'dir/f ' || p_partkey || '.c' AS file FROM part WHERE p_size % 5 = 0")
def unmerged_files(spark, sf_dir):
    p, s = F.col("p_partkey"), F.col("p_size")
    code = F.element_at(F.array(*map(F.lit, ("UU", " M", "AA", "UD", "??"))), (s % 5 + 1).cast("int"))
    lines = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.format_string("%s dir/f %d.c", code, p).alias("line"))
    return text.unmerged(lines)


@query("""SELECT c_custkey AS customer, CASE WHEN c_custkey % 3 = 0 THEN 'abcdef' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') || '_' || '0123456' END AS pair,
  CASE WHEN c_custkey % 3 = 0 THEN 'abcdef' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS a FROM customer""")
def dataset_folders(spark, sf_dir):
    """Folders of a data set: two commits joined by an underscore, or something else."""
    k = F.col("c_custkey")
    folder = F.when(k % 3 == 0, F.format_string("abcdef%07d_0123456", k)).when(k % 3 == 1, F.format_string("abc_%d", k)).otherwise(F.format_string("abcdef%07dx_0123456", k))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("customer"), text.pair_of(F.concat(F.lit("/data/set/"), folder, F.lit("/va/x.txt"))).alias("pair"))
    return rows.select("customer", "pair", text.commits_of(F.col("pair"))[0].alias("a"))


@query("SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) || '.parquet' AS name")
def listed_files(spark, sf_dir):
    """The names of a folder's table files."""
    found = text.list_files(spark, sf_dir).select("path", F.regexp_extract("path", r"([^/]+\.parquet)(?:/|$)", 1).alias("name"))
    return found.filter("name <> ''").select("name").distinct()


_FAST = """
f AS (SELECT p_partkey AS k, p_partkey % 200 AS header_seq, 'f' || p_partkey AS file, p_size, CASE WHEN p_size % 3 = 0 THEN 'A' WHEN p_size % 3 = 1 THEN 'B' END AS fast FROM part)"""


@query(f"""WITH {_FAST}
SELECT file, '#' AS diff_type, CAST(1 AS INT) AS start_a, CAST(p_size AS INT) AS len_a, CAST(2 AS INT) AS start_b, CAST(p_size AS INT) AS len_b FROM f WHERE fast IS NULL
UNION ALL SELECT file, CASE fast WHEN 'A' THEN '+' ELSE '-' END, CAST(k % 30 + i AS INT), CAST(i AS INT), CAST(k % 40 AS INT), CAST(3 AS INT) FROM f CROSS JOIN (SELECT unnest([1, 2]) AS i) WHERE fast IS NOT NULL""")
def fast_merged_diffs(spark, sf_dir):
    """Hunks of files merged without conflict come from their diffs."""
    k, size = F.col("p_partkey"), F.col("p_size")
    one = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit("x").alias("path"), k.alias("k"), k.cast("int").alias("header_seq"), F.format_string("f%d", k).alias("file"), F.when(size % 3 == 0, "A").when(size % 3 == 1, "B").alias("fast_merged"), size.cast("int").alias("size"))
    files = one.select("path", "header_seq", "file", F.lit(9).alias("lines_a"), F.lit(9).alias("lines_b"), "fast_merged")
    own = one.filter("fast_merged is null").select("path", "header_seq", "file", "fast_merged", F.lit(1).alias("hunk_seq"), F.lit("#").alias("diff_type"), F.lit(1).alias("start_a"), F.col("size").alias("len_a"), F.lit(2).alias("start_b"), F.col("size").alias("len_b"))
    i = F.explode(F.array(F.lit(1), F.lit(2))).alias("line_no")
    diffs = one.select("path", "file", "k", i).select("path", "file", "line_no", (F.col("k") % 30 + F.col("line_no")).cast("int").alias("start_a"), F.col("line_no").alias("len_a"), (F.col("k") % 40).cast("int").alias("start_b"), F.lit(3).alias("len_b"))
    return sinks.with_diffs(files, own, diffs)[1].select("file", "diff_type", "start_a", "len_a", "start_b", "len_b")


@query("""WITH m AS (SELECT c_custkey AS n, 'f' || c_custkey AS file, c_custkey % 90 AS a, c_custkey % 70 AS b, CASE WHEN c_nationkey % 2 = 0 THEN '+' ELSE '-' END AS kind FROM customer)
SELECT CAST(0 AS INT) AS part, n AS line_no, CAST(0 AS INT) AS k, '@ ' || file || ', ' || a || ', ' || b AS line FROM m
UNION ALL SELECT 0, n, 1, kind || ' 1, ' || a || ', = ,1, ' || b FROM m
UNION ALL SELECT 1, s_suppkey, 0, '# 1, ' || s_suppkey || ', = ,2, 3' FROM supplier""")
def prepended_lines(spark, sf_dir):
    """Whole-file hunks stand before the lines that a hunk file had."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    merged = c.select(F.lit("l").alias("path"), key.alias("line_no"), F.concat(F.lit("f"), key.cast("string"), F.lit(" --- "), F.when(F.col("c_nationkey") % 2 == 0, "A").otherwise("B")).alias("line"))
    counted = c.select(key.alias("line_no"), F.format_string("f%d, %d, %d", key, key % 90, key % 70).alias("line"))
    before = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("line_no"), F.format_string("# 1, %d, = ,2, 3", "s_suppkey").alias("line"))
    return sinks.prepended(sinks.whole_file_hunks(text.parse_direct_merges(merged), text.parse_line_counts(counted)), before)


def _module_lines(spark, sf_dir):
    """Orders as functions of modules in textual form, a hundred each: every third is declared only, every fifth local; each calls the next one."""
    k = F.col("o_orderkey")
    path = F.expr("cast(o_orderkey div 100 as string)")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    head = F.when(k % 3 == 0, F.format_string("declare i32 @f%d(i32)", k)).otherwise(F.concat(F.lit("define "), F.when(k % 5 == 0, "internal ").otherwise("dso_local "), F.format_string("i32 @f%d(i32 %%n) #0 !dbg !%d {", k, k + 1)))
    call, end = F.when(k % 3 != 0, F.format_string("  %%x = call i32 @f%d(i32 %%n), !dbg !9", k + 1)).otherwise(""), F.when(k % 3 != 0, "}").otherwise("")
    said = F.format_string('!%d = distinct !DISubprogram(name: "f%d", scope: !0, file: !0, line: %d, unit: !2)', k + 1, k, k % 300)
    rows = o.select(path.alias("path"), k, F.posexplode(F.array(head, call, end, said)).alias("i", "line"))
    rows = rows.select("path", (F.when(F.col("i") == 3, 1 << 40).otherwise(0) + k * 4 + F.col("i")).alias("line_no"), "line")
    file = o.select(path.alias("path")).distinct().select("path", F.lit(-1).cast("long").alias("line_no"), F.concat(F.lit('!0 = !DIFile(filename: "./a.c", directory: "/r/'), "path", F.lit('")')).alias("line"))
    return rows.unionByName(file)


@query("""SELECT 'f' || o_orderkey AS symbol, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0 THEN 'internal' ELSE 'external' END AS linkage, o_orderkey % 3 <> 0 AS is_defined, CASE WHEN o_orderkey % 3 <> 0 THEN 'f' || o_orderkey END AS name,
  CASE WHEN o_orderkey % 3 <> 0 THEN '/r/' || o_orderkey // 100 || '/a.c' END AS file, CAST(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 300 ELSE 0 END AS INT) AS debug_line FROM orders""")
def module_symbols(spark, sf_dir):
    lines = cut(_module_lines(spark, sf_dir), "module-lines")
    return ir.symbols(lines, ir.metadata(lines)).select("symbol", "linkage", "is_defined", "name", "file", "debug_line")


@query("""WITH f AS (SELECT o_orderkey AS k, o_orderkey // 100 AS path FROM orders),
c AS (SELECT a.k, a.path, b.k AS called, coalesce(b.k % 3 <> 0, false) AS defined FROM f a LEFT JOIN f b ON b.k = a.k + 1 AND b.path = a.path WHERE a.k % 3 <> 0)
SELECT 'func|/r/' || path || '/a.c|' || k % 300 || '|f' || k AS src_key, CASE WHEN defined THEN 'func|/r/' || path || '/a.c|' || called % 300 || '|f' || called END AS dst_key, 'f' || k + 1 AS callee, defined AS callee_defined FROM c""")
def module_calls(spark, sf_dir):
    lines = cut(_module_lines(spark, sf_dir), "module-lines")
    symbols = cut(ir.symbols(lines, ir.metadata(lines)), "symbols")
    return ir.calls(ir.uses(lines), symbols).select("src_key", "dst_key", "callee", "callee_defined")
