"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Source suffixes by language.
SUFFIXES = {
    "c_cpp": [".cc", ".cpp", ".hh", ".C", ".c", ".h", ".hpp", ".cxx", ".c++"],
    "java": [".java"],
    "python": [".py"],
    "javascript": [".js"],
    "csharp": [".cs"],
}


def encoded(path: Column) -> Column:
    """The file name under which a source path's facts and ranges are stored."""
    return F.translate(path, "/.", "@$")


def normalised(path: Column) -> Column:
    """An absolute path without empty parts and ``.``; ``..`` goes up one level and ``...`` two, not beyond the root."""
    up = lambda acc, n: F.slice(acc, 1, F.greatest(F.size(acc) - n, F.lit(0)))

    def step(acc: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), acc).when(part == "..", up(acc, 1)).when(part == "...", up(acc, 2)).otherwise(F.concat(acc, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def joined(path: Column, folder: Column) -> Column:
    """A path below its folder, if it has one, normalised."""
    return normalised(F.when(F.coalesce(folder, F.lit("")) == "", path).otherwise(F.concat(folder, F.lit("/"), path)))


def base_path(path: Column, folder: Column, root: str) -> Column:
    """The path below the project's root, null outside."""
    full, top = joined(path, folder), root.rstrip("/") + "/"
    return F.when(full.startswith(top), F.substring(full, len(top) + 1, 1 << 20))


def in_project(rows: DataFrame, files: DataFrame, root: str, path: str = "path", folder: str = "folder") -> DataFrame:
    """The rows whose path is a modified file (files: file), with it as ``file``."""
    return rows.withColumn("file", base_path(F.col(path), F.col(folder), root)).join(files.select("file").distinct(), "file", "left_semi")


def has_suffix(path: Column, language: str = "c_cpp") -> Column:
    """Whether a path ends like a source of the language."""
    any_of = F.lit(False)
    for s in SUFFIXES[language]:
        any_of = any_of | path.endswith(s)
    return any_of
