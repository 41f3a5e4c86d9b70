"""Dependency facts: merging modules, resolving types, linking symbols between modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hunkwise.functions.paths import encoded
from hunkwise.session import cut

SIDE = ["pair_id", "variant"]
# Entry points, which are never linked by name.
ENTRY_POINTS = ("main", "LLVMFuzzerTestOneInput")


def select_modules(files: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """The files (file) whose facts are in a listing (name): only these are read."""
    wanted = files.withColumn("name", encoded(F.concat(F.lit(root.rstrip("/") + "/"), F.col("file"))))
    return wanted.join(listing.select("name").distinct(), "name", "left_semi")


def defined(nodes: DataFrame) -> DataFrame:
    """Variables that are defined and named, functions that are defined, all types.  nodes: kind, name, is_defined."""
    named = F.coalesce(F.col("name"), F.lit("")) != ""
    return nodes.filter((F.col("kind") == "type") | (F.col("is_defined") & ((F.col("kind") == "func") | named)))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each (SIDE, node_key): that of the first module, by module_id."""
    rest = [c for c in nodes.columns if c not in (*SIDE, "node_key", "module_id")]
    first = nodes.groupBy(*SIDE, "node_key").agg(F.min(F.struct("module_id", *rest)).alias("f"))
    return first.select(*SIDE, "node_key", "f.*")


def merge_edges(deps: DataFrame) -> DataFrame:
    """The different dependencies of all modules."""
    return deps.select(*SIDE, "src_key", "dst_key", "dep_kind").distinct()


def file_nodes(nodes: DataFrame) -> DataFrame:
    """The different (SIDE, file, node_key) of all modules."""
    return nodes.select(*SIDE, "file", "node_key").distinct()


def wait_lists(ext_refs: DataFrame) -> DataFrame:
    """The different external names that each function refers to in any module."""
    return ext_refs.select(*SIDE, "src_key", "sym_kind", "ext_name").distinct()


def exported(symbols: DataFrame) -> DataFrame:
    """Symbols that other modules may name: external linkage, and no entry point."""
    return symbols.filter((F.col("linkage") == "external") & ~((F.col("sym_kind") == "func") & F.col("ext_name").isin(*ENTRY_POINTS)))


def merge_externals(externals: DataFrame) -> DataFrame:
    """One definition for each (SIDE, sym_kind, ext_name): that of the first module, then the least key."""
    first = externals.groupBy(*SIDE, "sym_kind", "ext_name").agg(F.min(F.struct("module_id", "node_key")).alias("f"))
    return first.select(*SIDE, "sym_kind", "ext_name", "f.module_id", "f.node_key")


def link_externals(ext_refs: DataFrame, externals: DataFrame) -> DataFrame:
    """Dependencies by name on other modules' symbols; unknown names are dropped."""
    found = wait_lists(ext_refs).join(merge_externals(externals), [*SIDE, "sym_kind", "ext_name"])
    return found.select(*SIDE, "src_key", F.col("node_key").alias("dst_key"), F.concat(F.lit("func_"), "sym_kind").alias("dep_kind")).distinct()


def link_internals(refs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dependencies, missing): internal callees that are nodes, and those that are not (a fault in the facts)."""
    known = nodes.select(*SIDE, F.col("node_key").alias("dst_key")).distinct()
    refs = refs.select(*SIDE, "src_key", "dst_key").distinct()
    return refs.join(known, [*SIDE, "dst_key"]).withColumn("dep_kind", F.lit("func_func")), refs.join(known, [*SIDE, "dst_key"], "left_anti")


def callee_links(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(internal, by name): how calls are linked.

    calls: SIDE, src_key, dst_key, callee, callee_defined, debug_ok, sub_name, is_direct, is_intrinsic.
    Indirect, intrinsic and self calls are dropped.  A defined callee with valid debug information is
    linked by key, or dropped without a subprogram name; every other callee is linked by name.
    """
    c = calls.filter(F.col("is_direct") & ~F.col("is_intrinsic") & (F.col("src_key") != F.coalesce("dst_key", F.lit(""))))
    sound = F.col("callee_defined") & F.col("debug_ok")
    inside = c.filter(sound & (F.coalesce("sub_name", F.lit("")) != "")).select(*SIDE, "src_key", "dst_key").distinct()
    by_name = c.filter(~sound).select(*SIDE, "src_key", F.lit("func").alias("sym_kind"), F.col("callee").alias("ext_name")).distinct()
    return inside, by_name


def resolve_types(types: DataFrame) -> DataFrame:
    """(type_id, base): the type that stands for each type in dependencies; those without one have no row.

    types: type_id, kind (basic, string, subroutine, composite, derived), tag (typedef or other),
    base_id, inside (in the project), is_decl.  Subroutines stand for themselves, composites too if
    inside and no forward declaration, typedefs if inside; other derived types inside stand for what
    their base stands for, however long the chain is.  Circles have no type that they stand for.
    """
    own = (F.col("kind") == "subroutine") | ((F.col("kind") == "composite") & F.col("inside") & ~F.col("is_decl")) | ((F.col("kind") == "derived") & F.col("inside") & (F.col("tag") == "typedef"))
    done = cut(types.filter(own).select("type_id", F.col("type_id").alias("base")), "types")
    chase = cut(types.filter((F.col("kind") == "derived") & F.col("inside") & (F.col("tag") != "typedef") & F.col("base_id").isNotNull()).select("type_id", "base_id"), "chase")
    # Each round doubles the reach; what is left when it exceeds the number of types goes round.
    for _ in range(chase.count().bit_length() + 1):
        done = cut(done.unionByName(chase.join(done.select(F.col("type_id").alias("base_id"), "base"), "base_id").select("type_id", "base")).distinct(), "types")
        chase = chase.join(done.select("type_id"), "type_id", "left_anti")
        chase = cut(chase.join(chase.select(F.col("type_id").alias("base_id"), F.col("base_id").alias("next")), "base_id", "left").select("type_id", F.coalesce("next", "base_id").alias("base_id")), "chase")
        if chase.isEmpty():
            break
    return done


def flatten_types(types: DataFrame, members: DataFrame) -> DataFrame:
    """(type_id, leaf): a subroutine's or nameless composite's members, resolved, down to named types.

    A type that is neither stands for its resolved self.  members: type_id, member_id.  Types may nest
    to any depth and hold each other.
    """
    base = cut(resolve_types(types), "resolved")
    open_ = types.filter((F.col("kind") == "subroutine") | ((F.col("kind") == "composite") & (F.coalesce("name", F.lit("")) == "") & (F.coalesce("identifier", F.lit("")) == ""))).select(F.col("type_id").alias("base"))
    step = members.join(base.withColumnRenamed("type_id", "member_id").withColumnRenamed("base", "next"), "member_id").select(F.col("type_id").alias("base"), "next").join(open_, "base", "left_semi")
    reach = cut(step.distinct(), "reach")
    n, before = reach.count(), -1
    while n != before:  # each round doubles the depth; pairs are finite, so circles end it too
        further = reach.join(reach.select(F.col("base").alias("next"), F.col("next").alias("leaf")), "next").select("base", F.col("leaf").alias("next"))
        reach = cut(reach.unionByName(further).distinct(), "reach", instead=reach)
        n, before = reach.count(), n
    every = base.select("type_id", F.col("base").alias("leaf")).unionByName(base.join(reach, "base").select("type_id", F.col("next").alias("leaf")))
    return every.join(open_.withColumnRenamed("base", "leaf"), "leaf", "left_anti").select("type_id", "leaf").distinct()


def type_edges(uses: DataFrame, flat: DataFrame, keys: DataFrame, dep_kind: str) -> DataFrame:
    """Dependencies on types: uses (SIDE, src_key, type_id), flat (type_id, leaf), keys (type_id, node_key)."""
    to = flat.join(keys.select(F.col("type_id").alias("leaf"), F.col("node_key").alias("dst_key")), "leaf")
    return uses.join(to, "type_id").select(*SIDE, "src_key", "dst_key", F.lit(dep_kind).alias("dep_kind")).distinct()


def faults(nodes: DataFrame, externals: DataFrame) -> DataFrame:
    """(rule, SIDE, subject): facts that break an assumption; none in sound facts."""
    place = nodes.filter((F.coalesce("debug_line", F.lit(0)) == 0) | (F.coalesce("file", F.lit("")) == "")).select(F.lit("node without line or file").alias("rule"), *SIDE, F.col("node_key").cast("string").alias("subject"))
    twice = externals.groupBy(*SIDE, "module_id", "sym_kind", "ext_name").agg(F.count("*").alias("n")).filter("n > 1")
    return place.unionByName(twice.select(F.lit("name defined twice in a module").alias("rule"), *SIDE, F.col("ext_name").alias("subject")))
