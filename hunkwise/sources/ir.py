"""Reader of compiler modules in LLVM's textual form (.ll): definitions, calls, types and their members.

A module is a file; ``path`` names it in all tables.  Lines come as (path, line_no, line) from
``text.read_lines``.  Everything is read from the debug metadata and from the bodies' calls and uses; a
file that is no module, or has no debug metadata, gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hunkwise.functions import names, paths
from hunkwise.sources.text import carried

# The forms of a module's lines, and what metadata nodes and tags stand for.
NODE = r"^!(\d+) = (?:distinct )?!(DI\w+)\((.*)\)\s*$"
LIST = r"^!(\d+) = (?:distinct )?!\{(.*)\}\s*$"
FIELD = r'(\w+): ("(?:[^"\\]|\\.)*"|[^,"]+)'
NAME = r'@("(?:[^"\\]|\\.)*"|[-\w.$]+)'
FUNCTION = rf"^(define|declare) (.*?){NAME}\("
GLOBAL = rf"^{NAME} = (.*?)\b(?:global|constant)\b"
CALLED = rf"\b(?:call|invoke)\b[^@]*?{NAME}\("
DEBUG = r"!dbg !(\d+)"
LOCAL = ("internal", "private")
KINDS = {"DIBasicType": "basic", "DIStringType": "string", "DISubroutineType": "subroutine", "DICompositeType": "composite", "DIDerivedType": "derived"}
TAGS = {"DW_TAG_typedef": "typedef", "DW_TAG_pointer_type": "pointer", "DW_TAG_const_type": "const", "DW_TAG_volatile_type": "volatile", "DW_TAG_array_type": "array"}


def _plain(name: Column) -> Column:
    """A name without its quotation marks."""
    return F.regexp_replace(name, '^"|"$', "")


def _part(pattern: str, k: int, line: str = "line") -> Column:
    return F.nullif(F.regexp_extract(line, pattern, k), F.lit(""))


def _number(value: Column) -> Column:
    """The number of a reference like !12."""
    return F.regexp_extract(value, r"^!(\d+)$", 1).try_cast("long")


def metadata(lines: DataFrame) -> DataFrame:
    """(path, id, what, fields): the nodes of debug metadata, fields as text without quotation marks."""
    body = F.regexp_extract("line", NODE, 3)
    keys, values = (F.regexp_extract_all(body, F.lit(FIELD), F.lit(k)) for k in (1, 2))
    values = F.transform(values, lambda x: F.trim(_plain(F.trim(x))))
    # Of a field that is named twice, the first counts.
    once = F.array_distinct(keys)
    fields = F.map_from_arrays(once, F.transform(once, lambda k: F.get(values, (F.array_position(keys, k) - 1).cast("int"))))
    found = lines.filter(F.col("line").rlike(NODE))
    return found.select("path", _part(NODE, 1).cast("long").alias("id"), _part(NODE, 2).alias("what"), fields.alias("fields"))


def lists(lines: DataFrame) -> DataFrame:
    """(path, id, seq, item): the references of metadata lists in order, null for what is none."""
    found = lines.filter(F.col("line").rlike(LIST)).select("path", _part(LIST, 1).cast("long").alias("id"), F.split(F.regexp_extract("line", LIST, 2), r",\s*").alias("items"))
    return found.select("path", "id", F.posexplode("items").alias("seq", "item")).withColumn("item", _number(F.col("item")))


def _located(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Adds file (folder and name joined) and line of rows with fields."""
    files = meta.filter("what = 'DIFile'").select("path", F.col("id").alias("_file"), paths.joined(F.col("fields")["filename"], F.col("fields")["directory"]).alias("file"))
    rows = rows.withColumn("_file", _number(F.col("fields")["file"])).withColumn("debug_line", F.coalesce(F.col("fields")["line"].try_cast("int"), F.lit(0)))
    return rows.join(files, ["path", "_file"], "left").drop("_file")


def symbols(lines: DataFrame, meta: DataFrame) -> DataFrame:
    """(path, symbol, sym_kind, linkage, is_defined, name, link_name, file, debug_line): functions and global variables.

    Those without debug metadata have null names and files.
    """
    local = F.lit(False)
    head = F.col("head")
    for word in LOCAL:
        local = local | head.rlike(rf"\b{word}\b")
    linkage = F.when(local, "internal").otherwise("external").alias("linkage")
    dbg = _part(DEBUG, 1).cast("long").alias("dbg")
    f = lines.filter(F.col("line").rlike(FUNCTION)).select("path", _plain(_part(FUNCTION, 3)).alias("symbol"), F.lit("func").alias("sym_kind"), F.coalesce(_part(FUNCTION, 2), F.lit("")).alias("head"), F.col("line").startswith("define").alias("is_defined"), dbg)
    g = lines.filter(F.col("line").rlike(GLOBAL)).select("path", _plain(_part(GLOBAL, 1)).alias("symbol"), F.lit("gvar").alias("sym_kind"), F.coalesce(_part(GLOBAL, 2), F.lit("")).alias("head"), F.lit(True).alias("is_defined"), dbg)
    g = g.withColumn("is_defined", ~head.rlike(r"\b(external|extern_weak)\b"))
    # A variable's metadata stands behind an expression.
    behind = meta.filter("what = 'DIGlobalVariableExpression'").select("path", F.col("id").alias("dbg"), _number(F.col("fields")["var"]).alias("var"))
    g = g.join(behind, ["path", "dbg"], "left").withColumn("dbg", F.coalesce("var", "dbg")).drop("var")
    said = meta.filter(F.col("what").isin("DISubprogram", "DIGlobalVariable")).select("path", F.col("id").alias("dbg"), "fields")
    rows = _located(f.unionByName(g).join(said, ["path", "dbg"], "left"), meta)
    return rows.select("path", "symbol", "sym_kind", linkage, "is_defined", F.col("fields")["name"].alias("name"), F.col("fields")["linkageName"].alias("link_name"), "file", "debug_line")


def definitions(symbols: DataFrame) -> DataFrame:
    """(path, node_key, kind, name, link_name, file, debug_line, is_defined): nodes as ``facts.defined`` takes them."""
    link = names.link_name(F.col("link_name"), F.col("name"))
    rows = symbols.filter("file is not null")
    return rows.select("path", names.node_key(F.col("sym_kind"), F.col("file"), F.col("debug_line"), link).alias("node_key"), F.col("sym_kind").alias("kind"), "name", "link_name", "file", "debug_line", "is_defined")


def uses(lines: DataFrame) -> DataFrame:
    """(path, line_no, symbol, callee, used): for each call and other use of a symbol in the body of function ``symbol``.

    callee is null where a symbol is not called, and ``used`` where it is; a call through a pointer has
    neither.
    """
    head = F.when(F.col("line").startswith("define "), _plain(_part(FUNCTION, 3))).when(F.col("line").startswith("}"), F.lit(""))
    body = carried(lines, head, "symbol").filter((F.coalesce("symbol", F.lit("")) != "") & ~F.col("line").startswith("define "))
    call = F.col("line").rlike(r"\b(?:call|invoke)\b")
    callee = F.regexp_extract_all("line", F.lit(CALLED), F.lit(1))
    every = F.regexp_extract_all("line", F.lit(NAME), F.lit(1))
    none = F.lit(None).cast("string")
    one = F.transform(callee, lambda x: F.struct(_plain(x).alias("callee"), none.alias("used")))
    rest = F.transform(F.filter(every, lambda x: ~F.array_contains(callee, x)), lambda x: F.struct(none.alias("callee"), _plain(x).alias("used")))
    pointer = F.when(call & (F.size(callee) == 0), F.array(F.struct(none.alias("callee"), none.alias("used"))))
    found = F.concat(one, rest, F.coalesce(pointer, F.slice(one, 1, 0)))
    return body.select("path", "line_no", "symbol", F.explode(found).alias("u")).select("path", "line_no", "symbol", "u.*")


def calls(uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, src_key, dst_key, callee, callee_defined, debug_ok, sub_name, is_direct, is_intrinsic), as ``facts.callee_links`` takes them with its sides."""
    link = names.link_name(F.col("link_name"), F.col("name"))
    known = symbols.filter("sym_kind = 'func'").withColumn("key", F.when(F.col("file").isNotNull(), names.node_key(F.col("sym_kind"), F.col("file"), F.col("debug_line"), link)))
    src = known.filter("key is not null and is_defined").select("path", "symbol", F.col("key").alias("src_key"))
    dst = known.select("path", F.col("symbol").alias("callee"), F.col("key").alias("dst_key"), F.col("is_defined").alias("callee_defined"), F.col("name").alias("sub_name"))
    rows = uses.filter("used is null").join(src, ["path", "symbol"]).join(dst, ["path", "callee"], "left")
    return rows.select(
        "path", "src_key", "dst_key", "callee", F.coalesce("callee_defined", F.lit(False)).alias("callee_defined"), F.col("dst_key").isNotNull().alias("debug_ok"), "sub_name",
        F.col("callee").isNotNull().alias("is_direct"), F.coalesce(F.col("callee").startswith("llvm."), F.lit(False)).alias("is_intrinsic"),
    )


def types(meta: DataFrame) -> DataFrame:
    """(path, type_id, kind, tag, name, identifier, base_id, is_decl, file, debug_line): types as ``facts`` and ``names.prototypes`` take them, without ``inside``.  Ids are ``<path>|<number>``."""
    rows = meta.filter(F.col("what").isin(*KINDS))
    rows = _located(rows.withColumn("tag", F.col("fields")["tag"]), meta)
    kind = F.coalesce(*[F.when(F.col("what") == k, v) for k, v in KINDS.items()])
    tag = F.coalesce(*[F.when(F.col("tag") == k, v) for k, v in TAGS.items()], F.lit("other"))
    key = lambda x: F.concat("path", F.lit("|"), x.cast("string"))
    base = _number(F.col("fields")["baseType"])
    decl = F.coalesce(F.col("fields")["flags"].contains("DIFlagFwdDecl"), F.lit(False))
    return rows.select("path", key(F.col("id")).alias("type_id"), kind.alias("kind"), tag.alias("tag"), F.col("fields")["name"].alias("name"), F.col("fields")["identifier"].alias("identifier"), key(base).alias("base_id"), decl.alias("is_decl"), "file", "debug_line")


def type_members(meta: DataFrame, lists: DataFrame) -> DataFrame:
    """(path, type_id, seq, member_id): what subroutines take and give, and composites hold, in order; null for nothing."""
    field = F.when(F.col("what") == "DISubroutineType", F.col("fields")["types"]).when(F.col("what") == "DICompositeType", F.col("fields")["elements"])
    owners = meta.select("path", F.col("id").alias("owner"), _number(field).alias("id")).filter("id is not null")
    key = lambda c: F.concat("path", F.lit("|"), F.col(c).cast("string"))
    return owners.join(lists, ["path", "id"]).select("path", key("owner").alias("type_id"), "seq", key("item").alias("member_id"))
