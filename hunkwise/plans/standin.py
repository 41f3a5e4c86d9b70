"""The engine's tables, derived from general tables by integer arithmetic.

No merge corpus comes with the general tables, so orders stand for definitions, parts for hunks,
lineitems for dependencies and suppliers for exported symbols.  A hundred orders make a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PAIR = "p0"
KINDS = ("func", "gvar", "type")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Painted nodes of both variants: pair_id, variant, file, node_key, kind, name, debug_line, start, end, paint_seq, desc_key."""
    o = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    rows = rows.select(o.alias("node_key"), F.expr("o_orderkey div 100").alias("file"), (o % 3).alias("k"), (1 + (o * 37) % 300).alias("s"), (o % 12).alias("more"), "o_orderstatus")

    def side(variant: str, shift: Column, rows: DataFrame) -> DataFrame:
        start = F.col("s") + shift
        return rows.select(
            F.lit(PAIR).alias("pair_id"), F.lit(variant).alias("variant"), "file", "node_key", _pick(KINDS, F.col("k")).alias("kind"), F.concat(F.lit("sym_"), F.col("node_key").cast("string")).alias("name"),
            start.alias("debug_line"), start.alias("start"), (start + F.col("more")).alias("end"), (F.col("s") * 1000000 + F.col("node_key")).alias("paint_seq"),
            F.concat_ws("|", F.col("file").cast("string"), (F.col("node_key") % 50).cast("string")).alias("desc_key"),
        )

    return side("A", F.lit(0), rows).unionByName(side("B", F.col("file") % 5, rows.filter("o_orderstatus <> 'F'")))


def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, dcb_id, file, diff_type, start_a, len_a, start_b, len_b.  The number of files is that of the orders / 100, read by a count."""
    files = max(1, _table(spark, sf_dir, "orders").count() // 100)
    p, n = F.col("p_partkey"), F.lit(files)
    start = 1 + (F.expr(f"p_partkey div {files}") * 23 + p) % 300
    return _table(spark, sf_dir, "part").select(
        F.lit(PAIR).alias("pair_id"), p.alias("dcb_id"), (p % n).alias("file"), _pick("+-#", (p + F.expr(f"p_partkey div {files}")) % 3).alias("diff_type"), start.alias("start_a"), ((F.col("p_size") * 3) % 40).cast("long").alias("len_a"),
        (start + (p % n) % 5).alias("start_b"), ((F.col("p_size") * 7) % 40).cast("long").alias("len_b"),
    )


def module_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, variant, module_id, src_key, dst_key, dep_kind: with repeats over modules, the same for both variants.

    Every lineitem is one; most are of a definition on itself, so that the graph falls into many parts.
    """
    src, step = F.col("l_orderkey"), F.when((F.col("l_partkey") + F.col("l_suppkey")) % 8 == 0, F.col("l_partkey") % 7).otherwise(3)
    rows = _table(spark, sf_dir, "lineitem")
    dst = F.expr("l_orderkey div 100") * 100 + (src % 100 + 97 + step) % 100
    kind = _pick(("func_type_proto", "func_type_body", "func_gvar", "func_func", "type_type", "gvar_type"), F.col("l_linenumber") % 6)
    rows = rows.select(F.lit(PAIR).alias("pair_id"), F.col("l_linenumber").cast("long").alias("module_id"), src.alias("src_key"), dst.alias("dst_key"), kind.alias("dep_kind"))
    return rows.withColumn("variant", F.explode(F.array(F.lit("A"), F.lit("B"))))


def module_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, variant, module_id, node_key, name: definitions as modules list them, repeated."""
    return _table(spark, sf_dir, "lineitem").select(
        F.lit(PAIR).alias("pair_id"), F.lit("A").alias("variant"), F.col("l_linenumber").cast("long").alias("module_id"), F.col("l_orderkey").alias("node_key"),
        F.concat(F.lit("m"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string")).alias("name"),
    )


def ext_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, variant, src_key, sym_kind, ext_name."""
    return _table(spark, sf_dir, "lineitem").select(F.lit(PAIR).alias("pair_id"), F.lit("A").alias("variant"), F.col("l_orderkey").alias("src_key"), F.lit("gvar").alias("sym_kind"), F.concat(F.lit("s"), (F.col("l_suppkey") % 60).cast("string")).alias("ext_name"))


def externals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, variant, module_id, sym_kind, ext_name, node_key; names repeat over modules."""
    s = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(F.lit(PAIR).alias("pair_id"), F.lit("A").alias("variant"), F.col("s_nationkey").cast("long").alias("module_id"), F.lit("gvar").alias("sym_kind"), F.concat(F.lit("s"), (s % 40).cast("string")).alias("ext_name"), s.alias("node_key"))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, variant, file, range_seq, rtype, start, end, name: ranges about variant A's definitions, some of which miss them."""
    n = nodes(spark, sf_dir).filter("variant = 'A'")
    kind = F.when(F.col("kind") != "type", F.col("kind")).otherwise(F.when(F.col("node_key") % 2 == 0, "alias").otherwise("composite"))
    name = F.when(F.col("node_key") % 10 == 0, "").when(F.col("node_key") % 4 == 0, "sym_").otherwise(F.col("name"))
    start = F.col("start") - F.col("node_key") % 3 + 1
    return n.select("pair_id", "variant", "file", F.col("paint_seq").alias("range_seq"), kind.alias("rtype"), start.alias("start"), (F.col("end") + F.col("node_key") % 2).alias("end"), name.alias("name"))


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type_id, kind, tag, identifier, name, base_id, inside, is_decl: each part is a type whose base has half its number."""
    p = F.col("p_partkey")
    kind = _pick(("basic", "subroutine", "composite", "derived", "derived", "derived", "derived"), p % 7)
    tag = F.when(p % 7 >= 3, _pick(("typedef", "pointer", "pointer", "const", "volatile"), p % 5)).when((p % 7 == 2) & (p % 4 == 0), "array").otherwise("other")
    name = F.when(p % 7 == 0, F.concat(F.lit("b"), p.cast("string"))).when((p % 7 == 2) & (p % 3 != 0), F.concat(F.lit("C"), p.cast("string"))).when((p % 7 >= 3) & (p % 5 == 0), F.concat(F.lit("T"), p.cast("string")))
    has_base = ((p % 7 >= 3) | ((p % 7 == 2) & (p % 4 == 0))) & (p % 11 != 0) & (p > 1)
    return _table(spark, sf_dir, "part").select(
        p.alias("type_id"), kind.alias("kind"), tag.alias("tag"), F.when((p % 7 == 2) & (p % 6 == 1), F.concat(F.lit("_Z"), p.cast("string"))).alias("identifier"), name.alias("name"),
        F.when(has_base, F.expr("p_partkey div 2")).alias("base_id"), (p % 13 != 0).alias("inside"), (p % 17 == 0).alias("is_decl"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type_id, seq, member_id of all subroutines and composites: two types of about a third of their number, null at times."""
    p = F.col("type_id")
    third = F.when(p > 3, F.expr("type_id div 3"))
    rows = types(spark, sf_dir).filter(F.col("kind").isin("subroutine", "composite"))
    return rows.select(p, F.posexplode(F.array(F.when(p % 10 != 0, third), third + 1)).alias("seq", "member_id"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of functions as facts.callee_links takes them, a lineitem each."""
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    return _table(spark, sf_dir, "lineitem").select(
        F.lit(PAIR).alias("pair_id"), F.lit("A").alias("variant"), o.cast("string").alias("src_key"), F.col("l_partkey").cast("string").alias("dst_key"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("callee"),
        (n % 2 == 0).alias("callee_defined"), (o % 3 != 0).alias("debug_ok"), F.when(F.col("l_partkey") % 4 != 0, F.lit("s")).otherwise("").alias("sub_name"), (n != 5).alias("is_direct"), (F.col("l_suppkey") % 9 == 0).alias("is_intrinsic"),
    )
