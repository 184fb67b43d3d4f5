"""Change sets between snapshots and what they affect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.grams import GramIndex, phrase_texts
from corpusloom.operators.matching import phrase_hits
from corpusloom.session import settle, with_global_rank


def fingerprints(files: DataFrame) -> DataFrame:
    """``path, hash``: content never enters a shuffle, its digest does."""
    return files.select("path", F.sha2("content", 256).alias("hash"))


def diff_snapshots(old: DataFrame, new: DataFrame, renames: bool = True) -> DataFrame:
    """``status, path, old_path``: added, modified, deleted, renamed (same content) files.

    Renames pair the i-th deleted with the i-th added copy of a content, by path order.
    Copies are numbered by a distributed ranking, so a content with very many copies is
    neither collected nor joined all against all.
    """
    both = fingerprints(old).withColumnRenamed("hash", "old_hash").join(
        fingerprints(new), "path", "full_outer"
    )
    status = (
        F.when(F.col("old_hash").isNull(), "A")
        .when(F.col("hash").isNull(), "D")
        .when(F.col("hash") != F.col("old_hash"), "M")
    )
    rows = both.select(
        status.alias("status"), "path", F.coalesce("hash", "old_hash").alias("hash")
    ).where("status IS NOT NULL")
    null = F.lit(None).cast("string").alias("old_path")
    if not renames:
        return rows.select("status", "path", null)
    rows = settle(rows)  # the changes are read twice; contents are hashed once
    moved = with_global_rank(
        rows.where("status <> 'M'"), [F.col("status"), F.col("hash"), F.col("path")]
    )
    starts = moved.groupBy("status", "hash").agg(F.min("pos").alias("start"))
    numbered = moved.join(starts, ["status", "hash"]).select(
        "status", "path", "hash", (F.col("pos") - F.col("start")).alias("nth")
    )
    paired = numbered.groupBy("hash", "nth").agg(
        F.max(F.when(F.col("status") == "A", F.col("path"))).alias("added"),
        F.max(F.when(F.col("status") == "D", F.col("path"))).alias("deleted"),
    )
    kind = F.when(F.col("deleted").isNull(), "A").when(F.col("added").isNull(), "D").otherwise("R")
    return rows.where("status = 'M'").select("status", "path", null).unionByName(
        paired.select(
            kind.alias("status"), F.coalesce("added", "deleted").alias("path"),
            F.when(kind == "R", F.col("deleted")).alias("old_path"),
        )
    )


def flat_changes(changes: DataFrame) -> DataFrame:
    """``status, path`` with every rename as a deletion and an addition."""
    return changes.select(
        F.inline(
            F.when(
                F.col("status") == "R",
                F.array(
                    F.struct(F.lit("D").alias("status"), F.col("old_path").alias("path")),
                    F.struct(F.lit("A").alias("status"), F.col("path").alias("path")),
                ),
            ).otherwise(F.array(F.struct(F.col("status").alias("status"), F.col("path").alias("path"))))
        )
    )


def update_chunks(chunks: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunk table after a change set: untouched chunks and the new ones of changed files."""
    touched = changes.select("path").distinct()
    return chunks.join(touched, "path", "left_anti").unionByName(fresh)


def update_counts(chunks: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row: chunks kept, removed and added."""
    touched = changes.select("path").distinct().withColumn("gone", F.lit(1))
    flags = chunks.join(touched, "path", "left").agg(
        F.count_if(F.col("gone").isNull()).alias("kept"),
        F.count_if(F.col("gone").isNotNull()).alias("removed"),
    )
    return flags.withColumn("added", fresh.agg(F.count("*").alias("n")).scalar())


def affected_pages(pages: DataFrame | GramIndex, changes: DataFrame, content: str = "content") -> DataFrame:
    """Pages that mention a changed file; ``pages`` may be a gram index of their contents by ``path``.

    Full path, directory and file name, file name: each contains the bare name, so a page
    mentions the file in any form exactly if it contains the name without extension.
    """
    names = changes.select(T.stem("path").alias("name")).distinct().where("name <> ''")
    if isinstance(pages, GramIndex):
        return phrase_texts(pages, names, ["name"], "name").select("path").distinct()
    return phrase_hits(pages, ["path"], content, names, ["name"], "name").select("path").distinct()


def pages_to_create(changes: DataFrame, pages: DataFrame) -> DataFrame:
    """``page, files``: modules of added files that none of three candidate pages covers."""
    added = changes.where("status = 'A'").select("path", T.dir_name("path").alias("dir"))
    module = F.when(F.col("dir") == ".", T.stem("path")).otherwise(T.base_name("dir"))
    modules = added.select("dir", module.alias("module")).groupBy("dir", "module").agg(F.count("*").alias("files"))
    candidates = modules.select(
        "dir", "module",
        F.explode(
            F.array(
                F.concat("module", F.lit(".md")),
                F.concat(F.regexp_replace("dir", "/", "-"), F.lit(".md")),
                F.concat(F.lit("modules/"), "module", F.lit(".md")),
            )
        ).alias("path"),
    )
    covered = candidates.join(pages.select("path"), "path", "left_semi").select("dir", "module").distinct()
    return (
        modules.join(covered, ["dir", "module"], "left_anti")
        .groupBy(F.concat("module", F.lit(".md")).alias("page"))
        .agg(F.sum("files").alias("files"))
    )
