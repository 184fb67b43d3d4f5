"""Profile of a file inventory: counts, sizes, estimates, batches, directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.functions import text as T


def counts_by(rows: DataFrame, key: Column, name: str) -> DataFrame:
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def extension_counts(files: DataFrame) -> DataFrame:
    return counts_by(files, T.extension("path"), "ext")


def language_counts(files: DataFrame) -> DataFrame:
    return counts_by(files, T.language("path"), "language")


def totals(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size")
    )


def largest(files: DataFrame, most: int = 10) -> DataFrame:
    return files.select("path", "size").orderBy(F.col("size").desc(), "path").limit(most)


def top_extensions(files: DataFrame, most: int = 10) -> DataFrame:
    return extension_counts(files).orderBy(F.col("n").desc(), "ext").limit(most)


# Prices per million tokens, shares of tokens read and written, speeds.
INPUT_PRICE, OUTPUT_PRICE = 3, 15
INPUT_SHARE, OUTPUT_SHARE = 2, 0.5
FILES_PER_MINUTE, FILES_PER_PAGE, MINUTES_PER_PAGE = 100, 10, 0.5


def estimate(files: DataFrame) -> DataFrame:
    """One row: chunks, tokens, cost and minutes to index and document the files."""
    n = F.col("files")
    tokens = F.col("chunks") * (fixed.CHARS_PER_CHUNK // fixed.CHARS_PER_TOKEN)
    cost_in = tokens * INPUT_SHARE / 1e6 * INPUT_PRICE
    cost_out = tokens * OUTPUT_SHARE / 1e6 * OUTPUT_PRICE
    indexing = n / FILES_PER_MINUTE
    writing = F.ceil(n / FILES_PER_PAGE) * MINUTES_PER_PAGE
    return (
        totals(files)
        .withColumn("chunks", F.ceil(F.col("total_size") / fixed.CHARS_PER_CHUNK))
        .select(
            "files", "total_size", "chunks", tokens.alias("tokens"),
            F.round(cost_in, 2).alias("input_cost"),
            F.round(cost_out, 2).alias("output_cost"),
            F.round(cost_in + cost_out, 2).alias("total_cost"),
            F.round(indexing, 1).alias("indexing_minutes"),
            F.round(writing, 1).alias("generation_minutes"),
            F.round(indexing + writing, 1).alias("total_minutes"),
        )
    )


def local_estimate(files: DataFrame, tokens_per_second: float) -> DataFrame:
    """One row: minutes on a local model of the given speed, disk for the vectors in GB."""
    return estimate(files).select(
        "tokens",
        F.round(F.col("tokens") * (INPUT_SHARE + OUTPUT_SHARE) / tokens_per_second / 60, 1).alias("generation_minutes"),
        F.round(F.col("chunks") * 0.001, 1).alias("cache_gb"),
    )


def batch_plan(chunks: DataFrame, size: int = fixed.BATCH_CHUNKS) -> DataFrame:
    """Batches of ``size`` chunks: number, first, end and count. Needs the chunk count only."""
    step = 10_000
    one = chunks.agg(F.count("*").alias("total_chunks")).withColumn(
        "total_batches", F.ceil(F.col("total_chunks") / size)
    ).where("total_chunks > 0")
    blocks = one.withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total_batches") - 1) / step)))
    )
    last = F.least(F.col("total_batches") - 1, F.col("_b") * step + step - 1)
    rows = blocks.withColumn("i", F.explode(F.sequence(F.col("_b") * step, last)))
    start = F.col("i") * size
    end = F.least(start + size, F.col("total_chunks"))
    return rows.select(
        (F.col("i") + 1).alias("batch"), "total_batches", "total_chunks",
        start.alias("batch_start"), end.alias("batch_end"), (end - start).alias("chunks_in_batch"),
    )


def first_files(rows: DataFrame, group: str, most: int, path: str = "path") -> DataFrame:
    """First ``most`` paths of every group with their position; a bounded ranking."""
    w = Window.partitionBy(group).orderBy(path)
    return (
        rows.select(group, path)
        .withColumn("pos", F.row_number().over(w))
        .where(F.col("pos") <= most)
        .select(group, "pos", path)
    )


def meaningful_dir(path: Column | str = "path") -> Column:
    """First directory that is not src, lib or app; null when there is none."""
    d = T.dir_name(path)
    parts = F.filter(F.split(d, "/"), lambda p: ~p.isin("src", "lib", "app", "."))
    return F.try_element_at(parts, F.lit(1))


def directory_structure(files: DataFrame) -> DataFrame:
    """``dir, files, depth, has_index`` of the significant directories."""
    parts = F.filter(F.split(T.dir_name("path"), "/"), lambda p: ~p.isin("src", "lib", "app"))
    rows = files.select("path", meaningful_dir().alias("dir"), F.size(parts).alias("depth")).where("dir IS NOT NULL")
    return rows.groupBy("dir").agg(
        F.count("*").alias("files"),
        F.min(F.struct("path", "depth"))["depth"].alias("depth"),
        F.bool_or(T.ends_with_any("path", ["/index.ts", "/index.tsx"])).alias("has_index"),
        F.min("path").alias("first_path"),
    )


def indexed_files(chunks: DataFrame) -> DataFrame:
    return chunks.select("path").distinct()


def entry_points(files: DataFrame, most: int = 20) -> DataFrame:
    """First ``most`` anchored entry points, index files after the others."""
    anchored = F.col("path").rlike(T.any_of(fixed.ANCHORED_ENTRY_PATTERNS))
    index = T.ends_with_any("path", fixed.INDEX_FILE_SUFFIXES)
    rows = files.where(anchored | index).select("path", F.when(anchored, 0).otherwise(1).alias("kind")).distinct()
    return rows.orderBy("kind", "path").limit(most)


def minimum_pages(files: DataFrame) -> DataFrame:
    """One row: pages to plan at least, one per eight source files between 5 and 25."""
    n = F.count_if(~T.extension("path").isin(fixed.DOC_EXTENSIONS))
    return files.agg(n.alias("source_files")).select(
        "source_files",
        F.greatest(F.lit(5), F.least(F.lit(25), F.ceil(F.col("source_files") / 8))).alias("min_pages"),
    )


def bundle_manifest(bundle: DataFrame) -> DataFrame:
    """One row: wiki pages and size, index parts, of a bundle table ``section, path, size``."""
    wiki = F.col("section") == "wiki"
    return bundle.agg(
        F.count_if(wiki & F.col("path").endswith(".md")).alias("page_count"),
        F.coalesce(F.sum(F.when(wiki, F.col("size"))), F.lit(0)).alias("wiki_size"),
        F.count_if(~wiki).alias("chunk_count"),
    )
