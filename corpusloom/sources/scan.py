"""Corpus scans: files from storage or any table with a path, inventories, change lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.functions import text as T


def read_files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """``path, size, modified[, content]`` of every file below ``root``, paths relative to it.

    Without ``content`` the scan lists files only and reads no bytes. Spark's file listing
    passes over names that start with ``_`` or ``.``; corpora that need such files
    are handed to the operators as a table with ``path`` and ``content``.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file:") + "/"
    path = F.element_at(F.split(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), _literal(base), 2), -1)
    cols = [path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    if content:
        cols.append(F.decode("content", "UTF-8").alias("content"))
    return raw.select(*cols)


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def _in_dirs(names: list[str]) -> Column:
    """True if any directory of the path is one of the names."""
    dirs = F.split(T.dir_name("path"), "/")
    return F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in names]))


def indexable_files(files: DataFrame) -> DataFrame:
    """Files to index: allowed extensions outside excluded places, one row per path."""
    name = T.base_name("path")
    excluded = (
        _in_dirs(fixed.EXCLUDED_DIRS)
        | T.ends_with_any("path", fixed.EXCLUDED_SUFFIXES)
        | name.isin(fixed.EXCLUDED_NAMES)
    )
    allowed = T.ends_with_any("path", fixed.INDEXABLE_EXTENSIONS)
    return files.where(allowed & ~excluded).dropDuplicates(["path"])


def _inventory(files: DataFrame, extensions: list[str], ignored: list[str]) -> DataFrame:
    hidden = F.exists(
        F.split(T.dir_name("path"), "/"), lambda d: d.startswith(".") & (d != ".")
    )
    return files.where(T.extension("path").isin(extensions) & ~_in_dirs(ignored) & ~hidden)


def project_inventory(files: DataFrame) -> DataFrame:
    """Wide inventory ``path, ext, size``: source, config, data and documentation files."""
    rows = _inventory(files, fixed.INVENTORY_EXTENSIONS, fixed.INVENTORY_IGNORED_DIRS)
    return rows.select("path", T.extension("path").alias("ext"), "size")


def source_files(files: DataFrame) -> DataFrame:
    """Narrow scan: program source only."""
    return _inventory(files, fixed.SOURCE_EXTENSIONS, fixed.SOURCE_IGNORED_DIRS).select("path")


def wiki_files(files: DataFrame) -> DataFrame:
    """Markdown files outside hidden directories and package folders."""
    hidden = F.exists(
        F.split(T.dir_name("path"), "/"),
        lambda d: (d.startswith(".") & (d != ".")) | (d == "node_modules"),
    )
    return files.where(F.col("path").endswith(".md") & ~hidden)


def parse_changes(lines: DataFrame, line: str = "line") -> DataFrame:
    """``status, path`` from name-status lines; the two names of a rename become D and A.

    The status is its first letter; tabs inside a plain path stay.
    """
    parts = F.split(F.col(line), "\t")
    status = F.substring(F.element_at(parts, 1), 1, 1)
    rest = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "\t")
    renamed = F.array(
        F.struct(F.lit("D").alias("status"), F.get(parts, F.lit(1)).alias("path")),
        F.struct(F.lit("A").alias("status"), F.get(parts, F.lit(2)).alias("path")),
    )
    plain = F.array(F.struct(status.alias("status"), rest.alias("path")))
    rows = lines.where((F.size(parts) > 1) & (T.strip_ends(line) != ""))
    return rows.select(
        F.inline(F.when((status == "R") & (F.size(parts) == 3), renamed).otherwise(plain))
    ).where("path <> ''")


def changed_paths(changes: DataFrame) -> DataFrame:
    """Name-only change list, once per path."""
    return changes.select("path").distinct()
