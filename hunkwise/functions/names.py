"""Names, keys and line-range expressions of definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hunkwise.session import cut


def link_name(link: Column, name: Column) -> Column:
    """The linkage name or identifier if there is one, else the plain name."""
    return F.coalesce(F.nullif(link, F.lit("")), name)


def node_key(kind: Column, file: Column, line: Column, name: Column) -> Column:
    return F.concat_ws("|", kind, file, line.cast("string"), name)


def desc_key(kind: Column, file: Column, name: Column, prototype: Column | None = None) -> Column:
    """What a definition is matched by across variants: its kind, file and name, a function's prototype where given."""
    said = name if prototype is None else F.when((kind == "func") & prototype.isNotNull(), prototype).otherwise(name)
    return F.concat_ws("|", kind, file, said)


def shown_name(name: Column) -> Column:
    """A type without a name is shown as ``*``."""
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("*"))


def debug_state(has_file: Column, inside: Column, line: Column) -> Column:
    """-1 for a file outside the project, 1 for one inside with a line, 0 without a line or file."""
    return F.when(~has_file, 0).when(~inside, -1).when(line != 0, 1).otherwise(0)


def user_defined(kind: Column, file: Column, name: Column, line: Column, inside: Column) -> Column:
    """Whether a type is a composite or derived one with file, name and line in the project."""
    return kind.isin("composite", "derived") & (F.coalesce(file, F.lit("")) != "") & (F.coalesce(name, F.lit("")) != "") & (line != 0) & inside


def end_line(start: Column, length: Column) -> Column:
    """The last line; before the first one if the length is 0."""
    return start + length - 1


def relation(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """How a block lies to another: INCLUDE if within it, NOT_INCLUDE if apart, else PARTLY_INCLUDE."""
    return F.when((start >= other_start) & (end <= other_end), "INCLUDE").when((start > other_end) | (end < other_start), "NOT_INCLUDE").otherwise("PARTLY_INCLUDE")


def prototypes(types: DataFrame, members: DataFrame) -> DataFrame:
    """(type_id, rep) of types, built from the leaves up.

    types: type_id, kind (basic, subroutine, composite, derived), tag (array, pointer, const, volatile
    or other), identifier, name, base_id.  members: type_id, seq, member_id, in order, null members
    not counted.  A named type is ``[name]`` (a composite's identifier first); a subroutine is its
    members in braces and their number; an array ``[...base]``; a nameless pointer, const or volatile
    ``[*base]``, ``[constbase]``, ``[volatilebase]``, with ``[void]`` for no base.  Types that refer to
    themselves through nameless ones have no row.  Chains of pointers and the like may have any length;
    subroutines that nest take a round for each level.
    """
    name = F.coalesce(F.when(F.col("kind") == "composite", F.nullif("identifier", F.lit(""))), F.nullif("name", F.lit("")))
    named = types.withColumn("label", F.when(F.col("kind") != "subroutine", name))
    lead = F.when(F.col("tag") == "pointer", "*").when(F.col("tag") == "const", "const").when(F.col("tag") == "volatile", "volatile").when((F.col("kind") == "composite") & (F.col("tag") == "array"), "...")
    known = named.filter("label is not null").select("type_id", F.concat(F.lit("["), "label", F.lit("]")).alias("rep"))
    open_ = named.filter("label is null").withColumn("lead", lead)
    void = open_.filter("kind <> 'subroutine' and base_id is null and lead is not null and lead <> '...'")
    known = cut(known.unionByName(void.select("type_id", F.concat(F.lit("["), "lead", F.lit("[void]]")).alias("rep"))), "prototypes")
    wraps = _unwound(open_.filter("kind <> 'subroutine' and base_id is not null and lead is not null").select("type_id", F.concat(F.lit("["), "lead").alias("before"), F.lit("]").alias("after"), "base_id"))
    calls = cut(open_.filter("kind = 'subroutine'").select("type_id"), "calls")
    parts = members.filter("member_id is not null")
    while True:
        child = known.select(F.col("type_id").alias("base_id"), F.col("rep").alias("base"))
        new = wraps.join(child, "base_id").select("type_id", F.concat("before", "base", "after").alias("rep"))
        each = calls.join(parts, "type_id", "left").join(known.select(F.col("type_id").alias("member_id"), F.col("rep").alias("base")), "member_id", "left")
        whole = each.groupBy("type_id").agg(
            F.count("member_id").alias("n"), F.count("base").alias("got"), F.array_sort(F.collect_list(F.when(F.col("base").isNotNull(), F.struct("seq", "base")))).alias("in_order")
        ).filter("n = got")
        rep = F.concat(F.lit("{"), F.array_join(F.transform("in_order", lambda x: x["base"]), ""), F.lit("}="), F.col("n").cast("string"))
        new = cut(new.unionByName(whole.select("type_id", rep.alias("rep"))).join(known, "type_id", "left_anti"), "prototypes")
        if new.isEmpty():
            return known
        known = cut(known.unionByName(new), "prototypes")


def _unwound(wraps: DataFrame) -> DataFrame:
    """(type_id, before, after, base_id) with bases that wrap nothing, what stands around them joined; what leads into a circle is left out."""
    wraps = cut(wraps, "wraps")
    inner = lambda rows, *more: rows.select(F.col("type_id").alias("base_id"), F.col("base_id").alias("next"), *more)
    ends = wraps.select("type_id", "base_id")
    for _ in range(wraps.count().bit_length() + 1):  # each round doubles the reach; what wraps something still goes round
        ends = cut(ends.join(inner(ends), "base_id", "left").select("type_id", F.coalesce("next", "base_id").alias("base_id")), "ends")
        round_ = ends.join(wraps.select(F.col("type_id").alias("base_id")), "base_id", "left_semi")
        if round_.isEmpty():
            break
    wraps = cut(wraps.join(round_.select("type_id"), "type_id", "left_anti"), "wraps")
    while True:
        both = wraps.join(inner(wraps, F.col("before").alias("b"), F.col("after").alias("a")), "base_id", "left")
        if both.filter("next is not null").isEmpty():
            return wraps
        wraps = cut(both.select("type_id", F.concat("before", F.coalesce("b", F.lit(""))).alias("before"), F.concat(F.coalesce("a", F.lit("")), "after").alias("after"), F.coalesce("next", "base_id").alias("base_id")), "wraps")


def function_prototypes(functions: DataFrame, reps: DataFrame) -> DataFrame:
    """Adds prototype_rep, the name and its type's representation, to functions (name, type_id)."""
    return functions.join(reps, "type_id", "left").withColumn("prototype_rep", F.concat("name", "rep")).drop("rep")
